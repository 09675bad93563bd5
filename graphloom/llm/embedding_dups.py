"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction; a vector belongs to the fixed number of filters whose directions it
meets best. Directions are a structured random product code: after a random rotation the
coordinates are cut into two blocks, each block has its own random unit vectors, and a filter
is a pair of them, so the list of a vector's filters is decoded from two short score lists.
Vectors that share a filter are compared exactly, in double precision. How many filters a
vector has, and in how many independent codes, is fitted to the number of vectors: at most
``miss`` of the pairs at the threshold share none, as measured on random pairs.

Exact copies are first folded into one vector with a multiplicity. A filter with many members
is cut into slices that are compared pairwise as blocks, so no task holds a whole hot filter,
and no pair becomes a row: a block returns link counts and spanning links only. A pair that
shares several filters is counted in the least of them. A block's rows carry the components (in
single precision where that is exact) and only those of a vector's filters that come before.

Defined cases: a vector that is null, empty, zero or has null or non-finite components links
with nothing; vectors of different length never link; repeated ids are vectors of their own
and share the component of the least; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import released, stored
from graphloom.llm.components import connected_components

_BLOCK_ROWS = 1024
_CODED = "rep long, copies long, v binary, filters array<long>, packed binary"
_FOUND = "rep long, links long, root long"


class ProductCode:
    """Filters of one vector length: ``size`` * ``size`` directions, of which a vector meets its ``best`` ones."""

    def __init__(self, dim: int, size: int, best: int, seed: int = 11) -> None:
        rng = np.random.default_rng([seed, dim, size])
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.cut = (dim + 1) // 2
        self.codes = [rng.normal(size=(size, n)) for n in (self.cut, dim - self.cut)]
        norm = [np.linalg.norm(c, axis=1, keepdims=True) if c.shape[1] else 1.0 for c in self.codes]
        # a block's share of the unit direction follows its share of the coordinates
        self.codes = [c / n * math.sqrt(c.shape[1] / dim) for c, n in zip(self.codes, norm, strict=True)]
        self.size, self.best = size, best
        self.short = min(best, size)
        # the best sums of two falling lists lie where the ranks' product is small
        ranks = [(i, j) for i in range(self.short) for j in range(self.short) if (i + 1) * (j + 1) <= best]
        self.first, self.second = np.array(ranks, np.int64).T

    def _top(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.argpartition(-x, self.short - 1, axis=1)[:, : self.short]
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(x, at, 1), axis=1, kind="stable"), 1)
        return at, np.take_along_axis(x, at, 1)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The sorted filter numbers of each unit vector."""
        out = []
        for k in range(0, len(x), _BLOCK_ROWS):
            y = x[k : k + _BLOCK_ROWS] @ self.rotation
            (i, a), (j, b) = (self._top(z @ c.T) for z, c in zip((y[:, : self.cut], y[:, self.cut :]), self.codes, strict=True))
            order = np.argsort(-(a[:, self.first] + b[:, self.second]), axis=1, kind="stable")[:, : self.best]
            out.append(np.sort(np.take_along_axis(i[:, self.first] * self.size + j[:, self.second], order, 1), 1))
        return np.concatenate(out)


def code_size(n: int, *, best: int, members: float = 60.0) -> int:
    """Code vectors a block, for filters of about ``members`` vectors if each of ``n`` meets ``best``."""
    return math.ceil(math.sqrt(best * max(100.0, n / members)))


def _decode(codes: list[ProductCode], x: np.ndarray) -> np.ndarray:
    return np.concatenate([c.decode(x) + k * c.size**2 for k, c in enumerate(codes)], axis=1)


def missed(codes: list[ProductCode], dim: int, least: float, pairs: int = 4000) -> float:
    """Share of random pairs of cosine ``least`` without a common filter.

    The rotation is random, so it holds for any given pair, however the vectors lie.
    """
    rng = np.random.default_rng([5, dim])
    x, z = rng.normal(size=(2, pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    y = x if dim == 1 else least * x + math.sqrt(max(0.0, 1 - least * least)) * z
    a, b = _decode(codes, x), _decode(codes, y)
    return 1 - float(np.mean([np.isin(p, q, assume_unique=True).any() for p, q in zip(a, b, strict=True)]))


def fitted(n: int, dim: int, least: float, *, miss: float = 0.01, a_vector: int = 14, members: float = 60.0) -> list[ProductCode]:
    """Codes that leave at most ``miss`` of the pairs at the threshold without a common filter, at any ``n``.

    More filters a vector come first; where those don't help (few dimensions), coarser codes and then independent ones.
    """
    best, size = a_vector, code_size(n, best=a_vector, members=members)
    codes = [ProductCode(dim, size, best)]
    while (lost := missed(codes, dim, least)) > miss:
        if len(codes) > 1 or lost <= 0.3 and best >= 4 * a_vector:
            codes.append(ProductCode(dim, size, best, 11 + len(codes)))
            continue
        if best < 4 * a_vector:
            best += a_vector
            size = code_size(n, best=best, members=members)
        else:
            size = (size + 1) // 2
        codes = [ProductCode(dim, size, best)]
    return codes


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; very large and very small components are scaled first, so no square leaves the range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _block(table: pa.Table, least: float, kind: str, listed: str) -> pa.Table:
    """Links of one block of one filter: counts that belong here, and the least member reached."""
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    part, rep = np.array(table["slice"]), np.array(table["rep"])
    copies = np.array(table["copies"])
    x = np.frombuffer(b"".join(table["v"].to_pylist()), kind).reshape(len(rep), -1).astype(np.float64)
    x = _unit(x)
    near = x @ x.T >= least
    near[np.arange(len(x)), np.arange(len(x))] = False
    if low != high:
        near &= part[:, None] != part[None, :]
    if not near.any():
        return pa.Table.from_pydict({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    # a vector's filters before this one; pairs that share one of them are counted there
    before = table["before"].to_pylist()
    flat = np.frombuffer(b"".join(before), listed)
    who = np.repeat(np.arange(len(x)), [len(f) // flat.itemsize for f in before])
    names, column = np.unique(flat, return_inverse=True)
    counted = near
    if len(names):
        member = np.zeros((len(x), len(names)), np.float32)
        member[who, column] = 1
        counted = near & ~(member @ member.T > 0)
    links = counted @ copies
    root = rep.copy()
    while True:
        lower = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(1))
        if (lower == root).all():
            break
        root = lower
    some = near.any(1)
    return pa.Table.from_pydict({"rep": rep[some], "links": links[some].astype(np.int64), "root": root[some]})


def near_duplicates(vectors: DataFrame, *, least: float = 0.95, id_col: str = "vec_id", vector: str = "embedding", a_vector: int = 14, members: float = 60.0, miss: float = 0.01) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = rows.withColumn("sound", sound & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), F.col("v")))
    folded = rows.filter("sound").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    folded = stored(spark, folded, "vectors")
    plan, start = {}, 0  # by vector length: size, filters a vector, number of codes, first filter number, how components are sent
    exact = F.forall("v", lambda x: x.cast("float").cast("double") == x)
    for dim, n, narrow in sorted(folded.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)), F.min(exact)).collect()):
        codes = fitted(n, dim, least, miss=miss, a_vector=a_vector, members=members)
        plan[dim] = codes[0].size, codes[0].best, len(codes), start, "<f4" if narrow else "<f8"
        start += len(codes) * codes[0].size ** 2
    listed = "<u4" if start < 1 << 32 else "<u8"
    firsts, kinds = [p[3] for p in plan.values()], [p[4] for p in plan.values()]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, list[ProductCode]] = {}
        for b in batches:
            v = [np.array(x, "<f8") for x in b["v"].to_pylist()]
            lists: list[np.ndarray] = [np.empty(0, np.int64)] * len(v)
            for dim in {len(x) for x in v}:
                size, best, n_codes, first, _ = plan[dim]
                if dim not in made:
                    made[dim] = [ProductCode(dim, size, best, 11 + k) for k in range(n_codes)]
                mine = [k for k, x in enumerate(v) if len(x) == dim]
                x = np.stack([v[k] for k in mine])
                for k, f in zip(mine, _decode(made[dim], _unit(x)), strict=True):
                    lists[k] = f + first
            yield pa.RecordBatch.from_pydict(
                {
                    "rep": b["rep"], "copies": b["copies"], "v": pa.array([x.astype(plan[len(x)][4]).tobytes() for x in v], pa.binary()),
                    "filters": pa.array(lists, pa.list_(pa.int64())), "packed": pa.array([f.astype(listed).tobytes() for f in lists], pa.binary()),
                }
            )

    coded = stored(spark, folded.select("rep", "copies", "v").mapInArrow(decode, _CODED), "coded")
    before = F.expr(f"substring(packed, 1, place * {np.dtype(listed).itemsize})")
    members_of = coded.select("rep", "copies", "v", "packed", F.posexplode("filters").alias("place", "filter")).withColumn("before", before)
    crowded = coded.select(F.explode("filters").alias("filter")).groupBy("filter").count().filter(F.col("count") > _BLOCK_ROWS)
    crowded = crowded.select("filter", F.ceil(F.col("count") / _BLOCK_ROWS).cast("int").alias("slices"))
    sliced = members_of.join(crowded, "filter", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    sliced = sliced.withColumn("slice", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    blocks = sliced.withColumn("other", other).withColumn("low", F.least("slice", "other")).withColumn("high", F.greatest("slice", "other"))

    def compare(table: pa.Table) -> pa.Table:
        at = int(np.searchsorted(firsts, table["filter"][0].as_py(), "right")) - 1
        return _block(table, least, kinds[at], listed)

    found = blocks.select("filter", "low", "high", "slice", "rep", "copies", "v", "before").groupBy("filter", "low", "high").applyInArrow(compare, _FOUND)
    found = stored(spark, found.groupBy("rep", "root").agg(F.sum("links").alias("links")), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    released(spark, coded)
    component = connected_components(spark, found.select(F.col("rep").alias("src"), F.col("root").alias("dst"))).select(F.col("node").alias("rep"), "component")
    per_rep = folded.select("h1", "h2", "rep", "copies").join(links, "rep", "left").join(component, "rep", "left")
    per_rep = per_rep.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.join(per_rep, ["h1", "h2"], "left")
    own = F.when(F.col("sound"), F.col("c")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("sound"), F.col("n")).otherwise(0).cast("long").alias("n_links"), own.alias("component_id"), (own == F.col("vec_id")).alias("kept"))
