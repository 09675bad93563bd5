"""Hard negatives by a kNN join over a Voronoi partition.

A row's score is its inner product with the anchor, components being whole numbers. One more
component, the root of the greatest squared norm less the row's own, puts all rows on a sphere,
where a greater score is a lesser distance. Rows belong to the cell of their nearest pivot and
keep their distance to it; anchors of neighbouring cells form groups of bounded size.

A first round joins each group with the cells nearest to its anchors and so finds scores that
an anchor's results have to beat. By the triangle inequality these bound the distances to each
other pivot at which a row can still matter to some anchor of the group, and the second round
brings a group only the rows within these bounds. Cells are cut into slices, so a block, one
group against one slice, holds a bounded number of rows, whatever cell or copy is frequent. A
block is compared exactly and gives each anchor's few best rows. Positives come first; their
scores then bound the negatives from both sides.

Of rows with equal vector and label only the first few by id can be among the results of any
anchor; the others are left out before the join, by a ranking with a limit ahead of its shuffle.

Defined cases: rows with a null id or label, a null vector or a null or non-finite component
take no part; rows that repeat id, label and vector count once, those that share an id alone
are rows of their own; a shorter vector counts as filled up with zeros; equal scores go by id;
scores are exact at any size, and one that no long can hold is an error; without an anchor or a
row the result is empty; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import released, small_batches, stored

#: The most pivots, and the rows that a cell should hold at least; pivots are the rows of least hash, a bounded sample.
PIVOTS, CELL_ROWS = 4096, 4096
#: Anchors of a group and rows of a slice: the sides of a block.
GROUP_ROWS, SLICE_ROWS = 2048, 8192
#: Cells that each anchor is joined with in the first round.
OWN_CELLS = 2
_LIMIT = 2**53
_POSITIVES, _NEGATIVES, _BOUNDS = "a long, id long, score long", "a long, nth int, id long, score long", "grp long, cell int, low double, high double"


class Voronoi:
    """Pivots on the sphere of radius ``radius``, and distances to them."""

    def __init__(self, pivots: np.ndarray, radius2: float) -> None:
        self.pivots, self.radius2 = pivots, radius2
        self.lift = np.sqrt(np.maximum(radius2 - (pivots**2).sum(1), 0))
        # distances are rounded; bounds leave room for that
        self.slack = 1e-6 * math.sqrt(radius2)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows to all pivots."""
        lift = np.sqrt(np.maximum(self.radius2 - (x**2).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.radius2 - 2 * (x @ self.pivots.T + lift[:, None] * self.lift), 0))

    def anchors(self, q: np.ndarray) -> np.ndarray:
        """Distances of anchors, whose added component is 0, to all pivots."""
        return np.sqrt(np.maximum((q**2).sum(1)[:, None] + self.radius2 - 2 * q @ self.pivots.T, 0))

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a row has this score with an anchor."""
        return np.sqrt(np.maximum((q**2).sum(1) + self.radius2 - 2 * score, 0))

    def chain(self) -> list[int]:
        """The pivots in an order in which each is followed by the nearest one left."""
        left = np.ones(len(self.pivots), bool)
        order = [0]
        while len(order) < len(left):
            left[order[-1]] = False
            near = self.pivots @ self.pivots[order[-1]] + self.lift * self.lift[order[-1]]
            order.append(int(np.argmax(np.where(left, near, -np.inf))))
        return order


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: by floating point where no sum can lose a digit, else by Python's integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if most < _LIMIT:
        return (q @ x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(q).astype(object) @ whole(x).astype(object).T


def best(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of the first ``k`` allowed rows of each anchor, greater scores and then earlier rows first."""
    n = score.shape[1]
    if score.dtype == object or int(np.abs(score).max(initial=0)) * n >= 2**62:
        order = [np.array(sorted(np.flatnonzero(a).tolist(), key=lambda j, s=s: (-int(s[j]), j))[:k], np.int64) for s, a in zip(score, allowed, strict=True)]
        return np.repeat(np.arange(len(order)), [len(o) for o in order]), np.concatenate([*order, np.zeros(0, np.int64)])
    none = -np.iinfo(np.int64).max
    key = np.where(allowed, score * n + np.arange(n - 1, -1, -1), none)
    first = np.argpartition(-key, min(k, n) - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), key.shape)
    at, place = np.nonzero(np.take_along_axis(key, first, 1) > none)
    return at, first[at, place]


def _joined(anchors: DataFrame, rows: DataFrame, bounds: DataFrame, slices: DataFrame, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``compare`` for each block: the anchors of a group and one slice of the rows within the group's bounds of a cell."""
    b = bounds.join(F.broadcast(slices), "cell")
    left = anchors.join(b.select("grp", "cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")), "grp")
    within = (F.col("dist") >= F.col("low")) & (F.col("dist") <= F.col("high"))
    cut = rows.join(F.broadcast(slices), "cell").withColumn("slice", F.pmod(F.xxhash64("id", "label"), F.col("slices")).cast("int"))
    right = cut.join(b.select("grp", "cell", "low", "high"), "cell").filter(within).select("grp", "cell", "slice", "id", "label", "v")
    return left.groupBy("grp", "cell", "slice").cogroup(right.groupBy("grp", "cell", "slice")).applyInArrow(compare, schema)


def _parts(left: pa.Table, right: pa.Table, kind: str):
    """Anchors against rows sorted by id, a thousand anchors at a time: (first anchor, scores, same label, ids, anchors, rows)."""
    right = right.sort_by("id")
    x, ids = _matrix(right["v"], kind), right["id"].to_numpy()
    q = _matrix(left["v"], kind)
    labels, own = right["label"].to_pylist(), left["label"].to_pylist()
    code = {v: k for k, v in enumerate(dict.fromkeys([*labels, *own]))}
    labels, own = (np.array([code[v] for v in side], np.int64) for side in (labels, own))
    for k in range(0, len(q), 1024):
        yield k, scores(q[k : k + 1024], x), own[k : k + 1024, None] == labels[None, :], ids, q[k : k + 1024], x


class Search:
    """The partition of one set of rows, and the two rounds of a search over it."""

    def __init__(self, spark: SparkSession, rows: DataFrame, anchors: DataFrame, kind: str, radius2: float, n: int) -> None:
        self.spark, self.kind = spark, kind
        some = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(max(1, min(PIVOTS, n // CELL_ROWS))).collect()
        self.voronoi = voronoi = Voronoi(_matrix(pa.array([bytes(r["v"]) for r in some], pa.binary()), kind), radius2)

        def place(batches, side: str = "rows"):
            for b in batches:
                for k in range(0, b.num_rows, 1024):
                    part = b.slice(k, 1024)
                    d = getattr(voronoi, side)(_matrix(part["v"], kind))
                    cell = d.argmin(1)
                    more = pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell], pa.float64())
                    yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*b.schema.names, "cell", "dist"])

        label = rows.schema["label"].dataType.simpleString()
        self.rows = stored(spark, rows.mapInArrow(place, f"id long, label {label}, v binary, cell int, dist double"), "placed")
        cells = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("least"), F.max("dist").alias("most")).collect()
        self.slices = spark.createDataFrame([(r["cell"], -(-r["n"] // SLICE_ROWS)) for r in cells], "cell int, slices int")
        self.least, self.most = np.full(len(some), np.inf), np.full(len(some), -np.inf)
        for r in cells:
            self.least[r["cell"]], self.most[r["cell"]] = r["least"], r["most"]
        named = anchors.mapInArrow(lambda batches: place(batches, "anchors"), f"a long, id long, label {label}, v binary, cell int, dist double")
        self.anchors = self._grouped(stored(spark, named, "anchors"))

    def _grouped(self, anchors: DataFrame) -> DataFrame:
        """Anchors with the group of their cell: neighbouring cells up to a number of anchors, or slices of a fuller one."""
        sizes = {r["cell"]: r["count"] for r in anchors.groupBy("cell").count().collect()}
        made, group, held = [], 0, 0
        for cell in (c for c in self.voronoi.chain() if c in sizes):
            if held and held + sizes[cell] > GROUP_ROWS:
                group, held = group + 1, 0
            slices = -(-sizes[cell] // GROUP_ROWS)
            made.append((cell, group, slices))
            group, held = (group, held + sizes[cell]) if slices == 1 else (group + slices, 0)
        of = self.spark.createDataFrame(made, "cell int, first long, parts long")
        return anchors.join(F.broadcast(of), "cell").select("a", "id", "label", "v", (F.col("first") + F.pmod(F.xxhash64("a"), F.col("parts"))).alias("grp"))

    def bounds(self, anchors: DataFrame, own: bool) -> DataFrame:
        """(grp, cell, low, high): distances to the cell's pivot at which a row may score from ``floor`` to ``ceiling`` with some anchor.

        A null floor or ceiling is none. The first round's cells are those near the group's anchors, the second one's all others.
        """
        voronoi, kind, least, most = self.voronoi, self.kind, self.least, self.most

        def of(table: pa.Table) -> pa.Table:
            low, high = np.full(len(least), np.inf), np.full(len(least), -np.inf)
            mine = np.zeros(len(least), bool)
            for k in range(0, table.num_rows, 256):
                part = table.slice(k, 256)
                q = _matrix(part["v"], kind)
                d = voronoi.anchors(q)
                mine[np.argsort(d, axis=1)[:, :OWN_CELLS]] = True
                floor, ceiling = (np.array(part[c].to_pylist(), np.float64) for c in ("floor", "ceiling"))
                far = np.where(np.isnan(floor), np.inf, voronoi.reach(q, np.nan_to_num(floor)) + voronoi.slack)[:, None]
                near = np.where(np.isnan(ceiling), -np.inf, voronoi.reach(q, np.nan_to_num(ceiling)) - voronoi.slack)[:, None]
                a, b = np.maximum(d - far, near - d) - voronoi.slack, d + far + voronoi.slack
                some = (a <= most) & (b >= least) & (a <= b)
                low, high = np.minimum(low, np.where(some, a, np.inf).min(0)), np.maximum(high, np.where(some, b, -np.inf).max(0))
            cell = np.flatnonzero((low <= high) & (mine if own else ~mine))
            grp = table["grp"][0].as_py()
            return pa.table({"grp": pa.array([grp] * len(cell), pa.int64()), "cell": pa.array(cell, pa.int32()), "low": low[cell], "high": high[cell]})

        return anchors.select("grp", "v", F.col("floor").cast("double").alias("floor"), F.col("ceiling").cast("double").alias("ceiling")).groupBy("grp").applyInArrow(of, _BOUNDS)

    def round(self, anchors: DataFrame, own: bool, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        bounds = stored(self.spark, self.bounds(anchors, own), "bounds")
        found = stored(self.spark, _joined(anchors, self.rows, bounds, self.slices, compare, schema), "found")
        released(self.spark, bounds)
        return found


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key with their place; the limit is applied before the shuffle as well."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def mine(
    vectors: DataFrame, anchors: Column, *, id_col: str = "vec_id", label: Column | str = "label", vector: Column | str = "embedding",
    positives: int = 5, negatives: int = 3, least_percent: int = 50, most_percent: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for all rows that meet ``anchors``.

    An anchor's positives are its first ``positives`` other rows of its label, a positive's
    negatives the first ``negatives`` rows of other labels that score at least ``least_percent``
    and at most ``most_percent`` of the positive's score. Components must be whole numbers.
    """
    spark = vectors.sparkSession
    small_batches(spark, rows=8192, size=16 << 20)
    given = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).alias("label"), (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>").alias("x"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    given = given.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    squares = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    n, n_anchors, width, most, radius2 = given.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("x")), F.max(F.array_max(F.transform("x", lambda c: F.abs(c)))), F.max(squares)).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not n_anchors:
        return empty
    kind = "<i2" if (most or 0) < 2**15 else "<i4" if most < 2**31 else "<f8"
    width = max(width, 1)

    def pack(batches):
        for b in batches:
            packed = [np.pad(np.array(x, np.float64), (0, width - len(x))).astype(kind).tobytes() for x in b["x"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], pa.array(packed, pa.binary()), b["anchor"]], names=["id", "label", "v", "anchor"])

    label_type = given.schema["label"].dataType.simpleString()
    packed = given.mapInArrow(pack, f"id long, label {label_type}, v binary, anchor boolean")
    # repeated rows count once
    packed = stored(spark, packed.groupBy("id", "label", "v").agg(F.max("anchor").alias("anchor")), "packed")
    wanted = stored(spark, packed.filter("anchor").select(F.monotonically_increasing_id().alias("a"), "id", "label", "v"), "wanted")
    copies = Window.partitionBy("label", "v").orderBy("id")
    rows = packed.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= max(positives + 1, negatives)).select("id", "label", "v")
    rows = stored(spark, rows, "rows")
    search = Search(spark, rows, wanted, kind, float(radius2), n)
    everyone = stored(spark, search.anchors, "grouped")

    def positive(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        a = left["a"].to_numpy()
        own = left["id"].to_numpy()
        for k, score, same, ids, q, x in _parts(left, right, kind) if left.num_rows and right.num_rows else ():
            # an anchor isn't its own positive
            for i, j in zip(*np.nonzero(own[k : k + len(q), None] == ids[None, :]), strict=True):
                same[i, j] &= not np.array_equal(q[i], x[j])
            at, row = best(score, same, positives)
            for o, v in zip(out, (a[k + at], ids[row], score[at, row]), strict=True):
                o.append(v)
        return _table(out, _POSITIVES)

    none = F.lit(None).cast("double")
    first = search.round(everyone.withColumns({"floor": none, "ceiling": none}), True, positive, _POSITIVES)
    kth = _first(first, ["a"], positives).groupBy("a").agg(F.when(F.count(F.lit(1)) == positives, F.min("score")).alias("floor"))
    bounded = everyone.join(kth, "a", "left").withColumn("ceiling", none)
    second = search.round(bounded, False, positive, _POSITIVES)
    chosen = stored(spark, _first(first.unionAll(second), ["a"], positives), "positives")
    released(spark, first, second)
    # a positive below 0 has no negatives: half of it would be more than its upper bound
    kept = chosen.filter("score >= 0").groupBy("a").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("wanted"))

    def negative(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        a, wanted = left["a"].to_numpy(), left["wanted"].to_pylist()
        for k, score, same, ids, q, _ in _parts(left, right, kind) if left.num_rows and right.num_rows else ():
            for nth in range(positives):
                have = [i for i in range(len(q)) if len(wanted[k + i]) > nth]
                if not have:
                    break
                goal = np.array([wanted[k + i][nth]["score"] for i in have], score.dtype)[:, None]
                s = score[have]
                fits = (100 * s >= least_percent * goal) & (100 * s <= most_percent * goal) & ~same[have]
                at, row = best(s, fits.astype(bool), negatives)
                place = np.array([wanted[k + i][nth]["place"] for i in have], np.int64)
                for o, v in zip(out, (a[k + np.array(have)[at]], place[at], ids[row], s[at, row]), strict=True):
                    o.append(v)
        return _table(out, _NEGATIVES)

    floor = F.array_min(F.transform("wanted", lambda w: w["score"])) * (least_percent / 100)
    bounded = everyone.join(kept, "a").withColumns({"floor": floor, "ceiling": F.array_max(F.transform("wanted", lambda w: w["score"])) * (most_percent / 100)})
    first = search.round(bounded, True, negative, _NEGATIVES)
    third = _first(first, ["a", "nth"], negatives).groupBy("a", F.col("nth").alias("place")).agg(F.when(F.count(F.lit(1)) == negatives, F.min("score")).alias("third"))
    # what each positive still asks for, and the least of it for the anchor
    open_ = chosen.filter("score >= 0").join(third, ["a", "place"], "left").groupBy("a").agg(F.min(F.coalesce(F.col("third").cast("double"), F.col("score") * (least_percent / 100))).alias("asked"))
    second = search.round(bounded.join(open_, "a").withColumn("floor", F.col("asked")).drop("asked"), False, negative, _NEGATIVES)
    final = _first(first.unionAll(second), ["a", "nth"], negatives).select("a", F.col("nth").alias("place"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = chosen.select("a", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = final.join(named, ["a", "place"]).join(wanted.select("a", F.col("id").alias("anchor_id")), "a")
    out = stored(spark, out.select(*empty.columns), "mined")
    released(spark, packed, wanted, rows, search.rows, everyone, first, second, chosen)
    return out


def _table(columns: list[list[np.ndarray]], schema: str) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int32() if c.endswith(" int") else pa.int64() for c in schema.split(", ")]
    return pa.table([pa.array([int(v) for part in c for v in part], kind) for c, kind in zip(columns, kinds, strict=True)], names=names)
