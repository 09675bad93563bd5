"""Encoding specs: versions, reserved channels, the older form, icons, scales on small rows."""

import json

import pytest

from graphloom.operators import encoding_spec as spec
from graphloom.plans.graph import Graph

PALETTES = {"okabe-ito": ["one", "two"], "viridis-9": ["low", "mid", "high"], "diverging-9": ["cold", "mild", "hot"]}


def test_versions_and_reserved_channels():
    good = {"version": 1, "node": {"color": {"driver": "x", "scale": {"kind": "fixed", "value": "red"}}}, "edge": {}}
    assert spec.parse(spec.serialize(good)) == good
    for bad in ({"version": 2, "node": {}}, {"node": {}}, {"version": "1"}, {"version": True}, {**good, "edge": {"dash": {}}}, {**good, "canvas": {"grid": {}}}):
        with pytest.raises(ValueError, match="version|reserved"):
            spec.parse(json.dumps(bad))


def test_older_form_and_icons():
    flat = {"nodeLabelProperty": "name", "edgeLabelProperty": "type", "nodeColorProperty": "kind", "nodeSizeProperty": "rank", "nodeSizeRange": [4, 8], "edgeWidthProperty": "", "edgeWidthRange": [1, 2]}
    made = spec.from_flat(flat)
    assert made["node"]["color"] == {"driver": "kind", "scale": {"kind": "categorical", "palette": "okabe-ito"}} and made["node"]["size"]["scale"]["range"] == [4, 8] and "width" not in made["edge"]
    first = spec.with_icons(made, "kind", {"a": "x", "b": "y"})
    second = spec.with_icons(first, "other", {"b": "z"})
    assert second["node"]["icon"] == {"driver": "kind", "scale": {"kind": "categorical", "overrides": {"a": "x", "b": "z"}}} and "icon" not in made["node"]


def test_scales(spark):
    nodes = spark.createDataFrame([("1", ["T"], 0, "a", 1.0), ("2", ["U"], 1, "b", 3.0), ("3", ["T"], 2, "c", None), ("4", [], 3, None, 9.0)], "id string, types array<string>, ord int, kind string, rank double")
    edges = spark.createDataFrame([("e1", "1", "2", "to", "2"), ("e2", "2", "3", "at", "x")], "id string, src string, dst string, type string, weight string")

    def made(node=None, edge=None):
        n, e = spec.apply({"version": 1, "node": node or {}, "edge": edge or {}}, Graph(nodes, edges), PALETTES)
        return {r["id"]: r for r in n.collect()}, {r["id"]: r for r in e.collect()}

    n, e = made()
    assert all(v is None for r in [*n.values(), *e.values()] for k, v in r.asDict().items() if k != "id")
    n, _ = made({"color": {"driver": "kind", "scale": {"kind": "categorical", "overrides": {"a": "own"}}}, "icon": {"driver": "types", "scale": {"kind": "categorical", "overrides": {"T": "tee"}}}, "label": {"driver": "kind"}})
    # colours without a palette take the default one, whose turns go round; icons have overrides alone
    assert [n[k]["color"] for k in "1234"] == ["own", "two", "one", None] and [n[k]["icon"] for k in "1234"] == ["tee", None, "tee", None] and [n[k]["label"] for k in "1234"] == ["a", "b", "c", ""]
    n, _ = made({"color": {"driver": "kind", "scale": {"kind": "categorical", "palette": "okabe-ito", "unmapped": "rest"}}, "size": {"driver": "rank", "scale": {"kind": "sequential", "domain": "auto", "range": [0, 8]}}})
    assert [n[k]["color"] for k in "1234"] == ["one", "two", "rest", "rest"] and [n[k]["size"] for k in "1234"] == [0, 2, None, 8]
    n, e = made({"color": {"driver": "rank", "scale": {"kind": "sequential", "ramp": "diverging", "domain": [1, 9]}}}, {"width": {"driver": "weight", "scale": {"kind": "sequential", "domain": "auto", "range": [1, 4]}}, "color": {"driver": "type", "scale": {"kind": "fixed", "value": "grey"}}, "label": {"driver": "type"}})
    assert [n[k]["color"] for k in "1234"] == ["cold", "mild", None, "hot"]
    assert [(e[k]["color"], e[k]["width"], e[k]["label"]) for k in ("e1", "e2")] == [("grey", 2.5, "to"), ("grey", None, "at")]


def test_registry_and_strokes(spark):
    from pyspark.sql import functions as F

    from graphloom.functions import values
    from graphloom.operators import summaries

    known = summaries.standard()
    assert known.get("none") is None and known.remove("edge-types") and not known.remove("edge-types") and [s.id for s in known.list()] == ["count-by-type"]
    known.register(summaries.of_key("count-by-type", "Again", lambda g: g.nodes, lambda: F.col("id")))
    g = Graph(spark.createDataFrame([("a", ["T"]), ("b", ["T"])], "id string, types array<string>"), spark.createDataFrame([], "id string, src string, dst string, type string"))
    assert sorted(map(tuple, known.run(g).collect())) == [("count-by-type", "a", 1), ("count-by-type", "b", 1)] and known.get("count-by-type").selected(g, ["b"]).collect()[0]["id"] == "b"
    fills = ["#000000", "#ffffff", "#56B4E9", "blue", None]
    df = spark.createDataFrame([(k, f) for k, f in enumerate(fills)], "k int, f string").orderBy("k")
    assert [r[0] for r in df.select(values.glyph_stroke(F.col("f"))).collect()] == ["#ffffff", "#1a1a1a", "#1a1a1a", "#ffffff", "#ffffff"]
    assert spark.range(1).select(values.weak_colours(["#eeeeee", "#000000", "red"], "#ffffff")).first()[0] == ["#eeeeee"]
