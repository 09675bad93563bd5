"""Fuzzy search over several fields of all nodes: a q-gram index finds candidates, edit distance scores them.

A field matches if some part of its text is within a third or so of the query's length in edits. Each edit
destroys at most q of the query's q-grams, so a field that matches holds at least a known number
of them; only nodes with such a field are scored. A query so short that no q-gram need remain is scored on all
nodes. The index is written once and sorted by gram, so a search reads few of its files. Without an index the
grams are looked for in the texts themselves, in one pass that shuffles nothing but the nodes found.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.graph import primary_type

#: Weights of the fields (fixed values), the share of a query that may differ, and the length of grams.
WEIGHTS = {"name": 3, "type": 2, "id": 1, "properties": 1}
MOST, Q = 0.35, 2


def fields(nodes: DataFrame) -> DataFrame:
    """(id, field, text): the lower-case texts that nodes are found by; properties are all texts and numbers, joined by spaces."""
    kinds = dict(nodes.dtypes)
    held = [c for c, t in kinds.items() if c not in ("id", "types", "ord") and (t in ("string", "tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal"))]
    name = F.coalesce(*(F.col(c).cast("string") for c in ("name", "label") if c in held), F.col("id"))
    texts = {"name": name, "type": F.coalesce(F.get("types", 0), F.lit("")), "id": F.col("id"), "properties": F.concat_ws(" ", *(F.col(c).cast("string") for c in held)) if held else F.lit("")}
    every = F.array(*(F.struct(F.lit(f).alias("field"), F.lower(t).alias("text")) for f, t in texts.items()))
    return nodes.select("id", F.explode(every).alias("x")).select("id", "x.*")


def gram_index(found: DataFrame) -> DataFrame:
    """(gram, field, id) of all texts, sorted by gram within range partitions."""
    at = F.sequence(F.lit(1), F.length("text") - (Q - 1))
    grams = F.array_distinct(F.transform(at, lambda k: F.substring("text", k, F.lit(Q))))
    rows = found.filter(F.length("text") >= Q).select(F.explode(grams).alias("gram"), "field", "id")
    return rows.repartitionByRange("gram", "id").sortWithinPartitions("gram")


def needed(query: str) -> int:
    """So many of the query's grams are in any text that matches it."""
    return len(query) - Q + 1 - Q * int(MOST * len(query))


def _edits(query: str, text: str) -> int:
    """The least edit distance between the query and any part of the text."""
    row = list(range(len(query) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for k, q in enumerate(query, 1):
            last, row[k] = row[k], min(last + (c != q), row[k] + 1, row[k - 1] + 1)
        best = min(best, row[-1])
    return best


def _distance(query: str, text: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([_edits(query, t) for t in b.to_pylist()], pa.int32())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "int")(text)


def _grams(query: str) -> Counter[str]:
    """The query's grams, and how often it has each."""
    return Counter(query[k : k + Q] for k in range(len(query) - Q + 1))


def held(text: Column, query: str) -> Column:
    """How many of the query's grams a text holds."""
    return reduce(lambda a, b: a + b, (F.when(F.contains(text, F.lit(g)), n).otherwise(0) for g, n in _grams(query).items()))


def candidates(index: DataFrame, query: str) -> DataFrame:
    """(id, field) of the texts that hold as many of the query's grams as a match needs."""
    grams = _grams(query)
    times = F.element_at(F.create_map(*(F.lit(x) for kv in grams.items() for x in kv)), F.col("gram"))
    held = index.filter(F.col("gram").isin(*grams)).groupBy("id", "field").agg(F.sum(times).alias("held"))
    return held.filter(F.col("held") >= needed(query)).select("id", "field")


def search(nodes: DataFrame, query: str, *, limit: int = 20, index: DataFrame | None = None) -> DataFrame:
    """(id, score): the ``limit`` best nodes, ties by id; an empty query or one of a single character finds nothing.

    A field's share is what its weight is multiplied by: 1 for the query itself in it, less the
    share of the query that differs; a node's score is the sum over its fields that match.
    """
    q = query.strip().lower()
    texts = fields(nodes)
    if len(q) < 2:
        return texts.select("id", F.lit(0.0).alias("score")).limit(0)
    if needed(q) > 0:
        texts = texts.join(candidates(index, q), ["id", "field"], "left_semi") if index is not None else texts.filter(held(F.col("text"), q) >= needed(q))
    scored = texts.withColumn("edits", _distance(q, F.col("text"))).filter(F.col("edits") <= int(MOST * len(q)))
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), F.col("field"))
    total = scored.groupBy("id").agg(F.round(F.sum(weight * (1 - F.col("edits") / len(q))), 6).alias("score"))
    return total.orderBy(F.desc("score"), "id").limit(limit)


def others(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(id): the nodes that a search didn't find."""
    return nodes.select("id").join(found.select("id"), "id", "left_anti")


def by_type(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Found nodes with their type and score."""
    return nodes.select("id", primary_type().alias("type")).join(F.broadcast(found), "id")
