"""Encoding specs as JSON documents, and what they make of a graph's nodes and edges.

A spec maps channels of nodes and edges to drivers (a column, or ``types`` and ``type``) by a
scale: fixed, categorical (a palette in the order values are first seen, overrides, a colour for
what is left over) or sequential (a range of sizes, or steps of a ramp, over a domain). Version 1 is read; channels that
belong to something else can't be mapped.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.values import palette_step, scaled
from graphloom.operators.aggregates import first_seen_slots, number_of
from graphloom.plans.graph import Graph, primary_type

#: The version, and channels that aren't mapped by attributes.
VERSION = 1
RESERVED = ("effects.accent", "effects.halo", "edge.dash", "node.borderWeight", "edge.borderWeight", "canvas.background", "canvas.grid")
_DEFAULT_PALETTE = "okabe-ito"

Spec = dict[str, Any]


def parse(text: str) -> Spec:
    """A spec from its JSON; another version or a reserved channel is an error."""
    spec = json.loads(text)
    if not isinstance(spec, dict) or spec.get("version") != VERSION or isinstance(spec.get("version"), bool):
        raise ValueError(f"unsupported encoding version {spec.get('version') if isinstance(spec, dict) else None!r}")
    for target, channels in spec.items():
        for channel in channels if isinstance(channels, dict) else ():
            if f"{target}.{channel}" in RESERVED:
                raise ValueError(f"reserved channel {target}.{channel}")
    return spec


def serialize(spec: Spec) -> str:
    return json.dumps(spec, indent=2)


def from_flat(config: dict[str, Any]) -> Spec:
    """A spec from the older flat form: label, color and size properties of nodes, label and width of edges."""
    def sized(prop: str, span: str) -> Spec:
        return {"driver": config[prop], "scale": {"kind": "sequential", "domain": "auto", "range": config[span]}}

    node: Spec = {"label": {"driver": config.get("nodeLabelProperty")}}
    edge: Spec = {"label": {"driver": config.get("edgeLabelProperty")}}
    if config.get("nodeColorProperty"):
        node["color"] = {"driver": config["nodeColorProperty"], "scale": {"kind": "categorical", "palette": _DEFAULT_PALETTE}}
    if config.get("nodeSizeProperty"):
        node["size"] = sized("nodeSizeProperty", "nodeSizeRange")
    if config.get("edgeWidthProperty"):
        edge["width"] = sized("edgeWidthProperty", "edgeWidthRange")
    return {"version": VERSION, "node": node, "edge": edge}


def with_icons(spec: Spec, driver: str, icons: dict[str, str]) -> Spec:
    """The spec with icons of values merged in; an icon channel that is there keeps its driver, the new icons win."""
    old = spec["node"].get("icon") or {}
    scale = old.get("scale") or {}
    held = scale.get("overrides") or {} if scale.get("kind") == "categorical" else {}
    icon = {"driver": old.get("driver", driver), "scale": {"kind": "categorical", "overrides": {**held, **icons}}}
    return {**spec, "node": {**spec["node"], "icon": icon}}


def _lookup(values: dict[str, str], key: Column) -> Column:
    if not values:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def _driver(df: DataFrame, name: str | None) -> Column:
    if name == "types" and "types" in df.columns:
        return primary_type()
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _domain(df: DataFrame, driver: str, given: Any, name: str) -> DataFrame:
    """``df`` with the driver's number and its domain's ends, found in the data where the spec says so."""
    value = number_of(df, driver) if driver in df.columns else F.lit(None).cast("double")
    out = df.withColumn(f"__{name}", value)
    if given == "auto" or given is None:
        ends = out.agg(F.min(f"__{name}").alias(f"__{name}_low"), F.max(f"__{name}").alias(f"__{name}_high"))
        return out.join(F.broadcast(ends))
    return out.withColumns({f"__{name}_low": F.lit(float(given[0])), f"__{name}_high": F.lit(float(given[1]))})


def _channel(df: DataFrame, name: str, channel: Spec | None, palettes: dict[str, list[str]]) -> DataFrame:
    """``df`` with the channel's column ``__<name>_out``, null where nothing is said."""
    out, none = f"__{name}_out", F.lit(None).cast(_type(name))
    scale = (channel or {}).get("scale") or {}
    if not channel or not scale:
        return df.withColumn(out, none)
    driver, kind = channel.get("driver"), scale["kind"]
    if kind == "fixed":
        return df.withColumn(out, F.lit(scale["value"]).cast(_type(name)))
    if kind == "categorical":
        keyed = df.withColumn("__key", _driver(df, driver))
        palette = scale.get("palette")
        if palette is None and name == "color":
            palette = _DEFAULT_PALETTE
        steps = palettes.get(palette, []) if isinstance(palette, str) else palette or []
        left_over = F.lit(scale.get("unmapped")).cast("string")
        own = _lookup(scale.get("overrides") or {}, F.col("__key"))
        if not steps:
            return keyed.withColumn(out, F.coalesce(own, left_over)).drop("__key")
        slots = first_seen_slots(keyed, "__key")
        turn = F.element_at(F.array(*map(F.lit, steps)), (F.col("slot") % len(steps) + 1).cast("int"))
        step = turn if scale.get("unmapped") is None else F.when(F.col("slot") < len(steps), turn).otherwise(left_over)
        named = slots.select(F.col("value").alias("__key"), step.alias("__step"))
        return keyed.join(named, "__key", "left").withColumn(out, F.coalesce(own, "__step", left_over)).drop("__key", "__step")
    ranged = _domain(df, driver, scale.get("domain"), name)
    value, low, high = F.col(f"__{name}"), F.col(f"__{name}_low"), F.col(f"__{name}_high")
    if name in ("size", "width"):
        least, most = scale["range"]
        # a domain of one value has the middle of the range
        made = F.when(high > low, scaled(value, low, high, least, most)).otherwise(F.lit((least + most) / 2))
        result = F.when(value.isNotNull(), made)
    else:
        ramp = palettes["diverging-9" if scale.get("ramp") == "diverging" else "viridis-9"]
        result = F.when(value.isNotNull(), palette_step(F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.5)), ramp))
    return ranged.withColumn(out, result).drop(f"__{name}", f"__{name}_low", f"__{name}_high")


def _type(name: str) -> str:
    return "double" if name in ("size", "width") else "string"


def _label(df: DataFrame, channel: Spec | None) -> Column:
    if not channel or "driver" not in channel:
        return F.lit(None).cast("string")
    return F.coalesce(_driver(df, channel["driver"]), F.lit(""))


def apply(spec: Spec, graph: Graph, palettes: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, color, size, icon, shape, label; edges: id, color, width, label): the patch of a whole graph.

    Sizes are whole numbers, widths have one decimal; ``palettes`` has the named ones. Values are
    first seen in order of ``ord``, edges without one in order of their ids.
    """
    nodes = graph.nodes if "ord" in graph.nodes.columns else graph.nodes.withColumn("ord", F.col("id"))
    edges = graph.edges.withColumn("ord", F.col("id")) if "ord" not in graph.edges.columns else graph.edges
    node, edge = spec.get("node") or {}, spec.get("edge") or {}
    for name in ("color", "size", "icon", "shape"):
        nodes = _channel(nodes, name, node.get(name), palettes)
    for name in ("color", "width"):
        edges = _channel(edges, name, edge.get(name), palettes)
    return (
        nodes.select("id", F.col("__color_out").alias("color"), F.round("__size_out").cast("long").alias("size"), F.col("__icon_out").alias("icon"), F.col("__shape_out").alias("shape"), _label(nodes, node.get("label")).alias("label")),
        edges.select("id", F.col("__color_out").alias("color"), F.round("__width_out", 1).alias("width"), _label(edges, edge.get("label")).alias("label")),
    )
