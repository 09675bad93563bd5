"""Shape validation of nodes: one pass, one array of violations for each (node, shape)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBERS = ("byte", "short", "int", "long", "bigint", "smallint", "tinyint", "float", "double")
SEVERITIES = ("info", "warning", "violation")


@dataclass(frozen=True)
class Rule:
    """Constraints of one property; ``severity`` overrides the usual one (pattern warns, others violate)."""

    path: str
    min_count: int = 0
    datatype: str | None = None
    pattern: str | None = None
    least: float | None = None
    most: float | None = None
    values: tuple[Any, ...] | None = None
    severity: str | None = None


@dataclass(frozen=True)
class Shape:
    id: str
    target: str
    rules: tuple[Rule, ...]
    closed: bool = False
    ignored: tuple[str, ...] = field(default=())


def _has_type(kind: str, datatype: str, c: Column) -> bool | Column:
    if datatype == "number":
        return kind.startswith("decimal") or kind in _NUMBERS
    if datatype == "string":
        return kind == "string"
    if datatype == "boolean":
        return kind == "boolean"
    if datatype == "date":
        return kind in ("date", "timestamp", "timestamp_ntz") or F.try_to_timestamp(c.cast("string")).isNotNull()
    if datatype == "uri":
        return c.cast("string").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$")
    raise ValueError(f"unknown datatype {datatype!r}")


def _violations(rule: Rule, kind: str | None) -> list[Column]:
    c = F.col(rule.path) if kind else F.lit(None).cast("string")
    text = c.cast("string")
    missing = c.isNull() | (text == "")

    def found(bad: Column, message: str, usual: str = "violation") -> Column:
        v = F.struct(F.lit(rule.path).alias("path"), F.lit(message).alias("message"), F.lit(rule.severity or usual).alias("severity"))
        return F.when(bad, v)

    out = []
    if rule.min_count > 0:
        out.append(found(missing, "missing"))
    if not kind:
        return out
    if rule.datatype:
        ok = _has_type(kind, rule.datatype, c)
        out.append(found(~missing & ~(F.lit(ok) if isinstance(ok, bool) else ok), "datatype"))
    if rule.pattern:
        out.append(found(~missing & ~text.rlike(rule.pattern), "pattern", "warning"))
    if rule.least is not None:
        out.append(found(~missing & (c < rule.least), "minInclusive"))
    if rule.most is not None:
        out.append(found(~missing & (c > rule.most), "maxInclusive"))
    if rule.values is not None:
        out.append(found(~missing & ~c.isin(list(rule.values)), "in"))
    return out


def validate(nodes: DataFrame, shapes: list[Shape]) -> DataFrame:
    """(id, shape, violations): one row for each node of a shape's target class."""
    types = dict(nodes.dtypes)
    fixed = {"id", "types", "ord"}

    def one(shape: Shape) -> DataFrame:
        checks = [v for r in shape.rules for v in _violations(r, types.get(r.path))]
        if shape.closed:
            allowed = fixed | set(shape.ignored) | {r.path for r in shape.rules}
            for c in [c for c in nodes.columns if c not in allowed]:
                checks.append(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("path"), F.lit("closed").alias("message"), F.lit("violation").alias("severity"))))
        empty = F.array().cast("array<struct<path:string,message:string,severity:string>>")
        found = F.array_compact(F.array(*checks)) if checks else empty
        return nodes.filter(F.array_contains("types", shape.target)).select("id", F.lit(shape.id).alias("shape"), found.cast("array<struct<path:string,message:string,severity:string>>").alias("violations"))

    return reduce(DataFrame.unionAll, map(one, shapes))


def findings(results: DataFrame) -> DataFrame:
    """(id, shape, path, message, severity), one row a violation."""
    return results.select("id", "shape", F.explode("violations").alias("v")).select("id", "shape", "v.*")


def of_shape(found: DataFrame, shape: str) -> DataFrame:
    """The findings of one shape."""
    return found.filter(F.col("shape") == shape)


def of_nodes(found: DataFrame, ids: DataFrame) -> DataFrame:
    """The findings at some focus nodes."""
    return found.join(ids.select("id").distinct(), "id", "left_semi")


def summary(results: DataFrame) -> DataFrame:
    """(shape, total, passing, failing, violations)."""
    bad = F.size("violations") > 0
    return results.groupBy("shape").agg(F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("passing"), F.count_if(bad).alias("failing"), F.sum(F.size("violations")).alias("violations"))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def drivers(results: DataFrame) -> DataFrame:
    """(id, n, worst): findings and worst severity of each focus node."""
    worst = F.max(severity_rank(F.col("severity")))
    return findings(results).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.element_at(F.array(*map(F.lit, SEVERITIES)), worst.cast("int")).alias("worst"))
