"""Visual encodings as columns: a declarative spec over node and edge properties, type maps, overrides, derived properties."""

from __future__ import annotations

import ast
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.values import finite, scaled
from graphloom.operators.aggregates import first_seen_slots
from graphloom.plans.graph import primary_type

SHAPES = ("ellipse", "rectangle", "diamond", "hexagon", "triangle", "star", "pentagon", "octagon")


@dataclass(frozen=True)
class Size:
    """A number to a range; without values, or with equal ones, everything has the middle size."""

    prop: str
    low: float = 4
    high: float = 32


def size_column(df: DataFrame, spec: Size) -> DataFrame:
    domain = df.agg(F.min(spec.prop).alias("__lo"), F.max(spec.prop).alias("__hi"))
    some = F.col("__hi") > F.col("__lo")
    middle = F.lit((spec.low + spec.high) / 2)
    value = F.when(some & F.col(spec.prop).isNotNull(), scaled(F.col(spec.prop), F.col("__lo"), F.col("__hi"), spec.low, spec.high)).otherwise(middle)
    return df.crossJoin(F.broadcast(domain)).withColumn("size", value).drop("__lo", "__hi")


def category_column(df: DataFrame, prop: str, steps: tuple[str, ...], name: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """Values in the order they are first seen take the steps in turn; overridden ones keep theirs, and their place."""
    slots = first_seen_slots(df, prop)
    step = F.element_at(F.array(*map(F.lit, steps)), (F.col("slot") % len(steps) + 1).cast("int"))
    if overrides:
        given = F.element_at(F.create_map(*(F.lit(x) for kv in overrides.items() for x in kv)), F.col("value"))
        step = F.coalesce(given, step)
    return df.join(slots.select(F.col("value").alias("__v"), step.alias(name)), F.col(prop).cast("string") == F.col("__v"), "left").drop("__v")


def apply_spec(nodes: DataFrame, *, color: str | None = None, palette: tuple[str, ...] = (), shape: str | None = None, size: Size | None = None, label: str = "name") -> DataFrame:
    """(id, color, shape, size, label): the patch of a whole graph; sizes are whole numbers."""
    out = nodes.withColumn("__label", F.coalesce(F.col(label).cast("string"), "id"))
    out = category_column(out, color, palette, "__color") if color else out.withColumn("__color", F.lit(None).cast("string"))
    out = category_column(out, shape, SHAPES, "__shape") if shape else out.withColumn("__shape", F.lit(SHAPES[0]))
    if size:
        out = size_column(out.withColumnRenamed("size", "__own"), Size("__own" if size.prop == "size" else size.prop, size.low, size.high))
    else:
        out = out.withColumn("size", F.lit(None).cast("double"))
    return out.select("id", F.col("__color").alias("color"), F.col("__shape").alias("shape"), F.round("size").alias("size"), F.col("__label").alias("label"))


def type_map(nodes: DataFrame, palette: tuple[str, ...]) -> DataFrame:
    """(type, color, shape) by the place of each type in order of name; a table as large as the schema."""
    from graphloom.plans.session import number_rows

    types = number_rows(nodes.select(F.explode("types").alias("type")).distinct(), "type")

    def pick(steps: tuple[str, ...]) -> Column:
        return F.element_at(F.array(*map(F.lit, steps)), ((F.col("n") - 1) % len(steps) + 1).cast("int"))

    return types.select("type", pick(palette).alias("color"), pick(SHAPES).alias("shape"))


def with_overrides(nodes: DataFrame, by_type: dict[str, str], by_id: DataFrame, name: str = "style") -> DataFrame:
    """Nodes with the style of their own rule, else of their type's."""
    of_type = F.element_at(F.create_map(*(F.lit(x) for kv in by_type.items() for x in kv)), primary_type()) if by_type else F.lit(None).cast("string")
    return nodes.join(by_id.select("id", F.col(name).alias("__s")), "id", "left").withColumn(name, F.coalesce("__s", of_type)).drop("__s")


_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / F.nullif(b, F.lit(0.0)), ast.Mod: lambda a, b: a % F.nullif(b, F.lit(0.0)), ast.Pow: F.pow}
_CALLS = {"sqrt": F.sqrt, "abs": F.abs, "floor": F.floor, "ceil": F.ceil, "round": F.round, "log": F.ln, "exp": F.exp, "min": F.least, "max": F.greatest}


def expression(text: str, columns: list[str]) -> Column:
    """An arithmetic expression over number columns as a Column; anything else in it is an error."""
    def made(n: ast.AST) -> Column:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name) and n.id in columns:
            return F.col(f"`{n.id}`").cast("double")
        if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
            return _BINARY[type(n.op)](made(n.left), made(n.right))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            return -made(n.operand) if isinstance(n.op, ast.USub) else made(n.operand)
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in _CALLS and not n.keywords:
            return _CALLS[n.func.id](*map(made, n.args)).cast("double")
        raise ValueError(f"not an arithmetic expression: {text!r}")

    return made(ast.parse(text.replace("^", "**"), mode="eval").body)


def derived(df: DataFrame, definitions: dict[str, str]) -> DataFrame:
    """``df`` with derived columns in order of definition, later ones seeing earlier; results that aren't finite are null, invalid definitions are left out."""
    def one(d: DataFrame, item: tuple[str, str]) -> DataFrame:
        try:
            return d.withColumn(item[0], finite(expression(item[1], d.columns)))
        except (ValueError, SyntaxError):
            return d

    return reduce(one, definitions.items(), df)
