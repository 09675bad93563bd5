"""N-gram Jaccard join: a grouped prefix join over word shingles, and its connected groups.

A document's set is its distinct shingles of ``n`` words (fewer words: the whole sequence as
one), each a 64-bit hash. Documents with equal sets form a class; classes with the same size
and prefix form a group, which is indexed once. Two sets can only reach the threshold if their
prefixes, the rarest shingles of a common order, share a shingle; group pairs found so are cut
by size, place of the shared shingle and a bitmap of the set, then expanded to classes and
verified on the whole sets.

The order of rarity comes from a sketch of fixed width that counts all documents. A shingle's
groups are a run of sorted rows. A first round links each member with few others of its run; a
second one compares everything that is not yet connected, so no link between separate parts is
lost while a group of many copies never becomes all its pairs. Long runs are cut into slices
that are compared as blocks.

Defined cases: null text or text without words has the empty set and links with nothing;
repeated rows are copies; a null id counts as the least id; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import by_size, released, small_batches, stored
from graphloom.llm.components import connected_components

#: Slots of the rarity sketch (1 byte each in every worker, 2 while it is counted) and slots that are added up together.
_SKETCH, _SKETCH_BLOCK = 1 << 24, 1 << 16
_RUN_ROWS = 20_000
_BITMAP_WORDS = 4
#: So many ids with their text's hash (16 bytes each) may be sent to every executor; more are joined by a shuffle.
_BROADCAST_IDS = 500_000
#: Bytes of a shingle hash that whole sets are compared by: two different shingles of a pair of sets agree in them with a chance of 2^-48.
_SET_BYTES = 6
_NULL_ID = -(1 << 63)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text: words between white space, A-Z in lower case."""
    words = text.encode().lower().split() if text else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    width = min(n, len(h))
    total = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        total = _mix(total * _FACTORS[k % 5] + h[k : len(h) - width + 1 + k] + np.uint64(k))
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def prefix_length(size: int, percent: int) -> int:
    """So many of the first shingles of a set must hold one of any partner's prefix."""
    return size - -(-percent * size // 100) + 1


def bitmap(h: np.ndarray) -> bytes:
    """Parities of the set's hashes over a few hundred places; sets differ in at least as many shingles as these differ."""
    bits = np.bincount((h >> np.uint64(7) & np.uint64(64 * _BITMAP_WORDS - 1)).astype(np.int64), minlength=64 * _BITMAP_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _packed(h: np.ndarray) -> bytes:
    return h.view(np.uint8).reshape(-1, 8)[:, :_SET_BYTES].tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // _SET_BYTES, 8), np.uint8)
    out[:, :_SET_BYTES] = np.frombuffer(b, np.uint8).reshape(-1, _SET_BYTES)
    return out.view(np.uint64).ravel()


def _rank(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte: exact below 32, then in sixteen steps for each doubling."""
    c = np.maximum(counts, 1).astype(np.float64)
    return np.where(counts < 32, counts, np.minimum(32 + np.floor(16 * np.log2(c / 32)), 255)).astype(np.uint8)


def _sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents hold a shingle of each slot, from all documents, as ranks of one byte."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, most = np.zeros(_SKETCH, np.uint16), np.int64(2**16 - 1)
        for b in batches:
            for texts in by_size(b["text"].to_pylist()):
                found = np.concatenate([shingles(t, n) for t in texts])
                at, c = np.unique((found & np.uint64(_SKETCH - 1)).astype(np.uint32), return_counts=True)
                slots[at] = np.minimum(slots[at] + c, most)
        blocks, z = slots.reshape(-1, _SKETCH_BLOCK), zstandard.ZstdCompressor(level=1)
        for k in np.flatnonzero(blocks.any(1)).tolist():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int64()), "slots": pa.array([z.compress(blocks[k].tobytes())], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total, z = np.zeros(_SKETCH_BLOCK, np.int64), zstandard.ZstdDecompressor()
        for x in table["slots"]:
            total += np.frombuffer(z.decompress(x.as_py()), np.uint16)
        packed = zstandard.ZstdCompressor(level=1).compress(_rank(total).tobytes())
        return pa.Table.from_pydict({"block": table["block"][:1], "slots": pa.array([packed], pa.binary())})

    out, z = np.zeros((_SKETCH // _SKETCH_BLOCK, _SKETCH_BLOCK), np.uint8), zstandard.ZstdDecompressor()
    for r in docs.select("text").mapInArrow(count, "block long, slots binary").groupBy("block").applyInArrow(add, "block long, slots binary").collect():
        out[r["block"]] = np.frombuffer(z.decompress(r["slots"]), np.uint8)
    return out.ravel()


def _sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, key, n, cls, grp, prefix, bits) of every document, stored; cls is null for the empty set."""
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(docs, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = sketch.value
        for b in batches:
            sizes, cls, grp, prefix, bits = [], [], [], [], []
            for t in b["text"].to_pylist():
                h = shingles(t, n)
                sizes.append(len(h))
                if not len(h):
                    for x in (cls, grp, prefix, bits):
                        x.append(None)
                    continue
                p = h[np.lexsort((h, slots[(h & np.uint64(_SKETCH - 1)).astype(np.int64)]))][: prefix_length(len(h), percent)]
                cls.append(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).astype(np.int64))
                grp.append(np.uint64(xxhash.xxh3_64_intdigest(p.tobytes(), seed=len(h))).astype(np.int64))
                prefix.append(p.astype(np.int64))
                bits.append(bitmap(h))
            yield pa.RecordBatch.from_pydict(
                {
                    "id": b["id"], "key": b["key"], "n": pa.array(sizes, pa.int64()), "cls": pa.array(cls, pa.int64()), "grp": pa.array(grp, pa.int64()),
                    "prefix": pa.array(prefix, pa.list_(pa.int64())), "bits": pa.array(bits, pa.binary()),
                }
            )

    out = stored(docs.sparkSession, docs.mapInArrow(run, "id long, key long, n long, cls long, grp long, prefix array<long>, bits binary"), "sets")
    sketch.destroy()
    return out


class _Runs:
    """Columns of some whole runs; a run has the rows of one shingle (and block of slices), by size."""

    def __init__(self, t: pa.Table, percent: int) -> None:
        self.percent = percent
        self.place, self.cls, self.comp, self.part = (np.array(t[c]) for c in ("place", "cls", "comp", "part"))
        self.n, self.pos = self.place >> 32, self.place & 0xFFFFFFFF
        self.bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(-1, _BITMAP_WORDS)
        key = [np.array(t[c]) for c in ("token", "block")]
        new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in key])])
        self.starts = np.flatnonzero(new)
        self.ends = np.append(self.starts[1:], len(new))
        self.first = self.starts[np.cumsum(new) - 1]
        self.cross = key[1] % 2 == 1

    def pairs(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the row pairs whose sets may reach the threshold and whose parts are separate."""
        small, large = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        keep = (self.comp[i] != self.comp[j]) & (100 * small >= self.percent * large) & (~self.cross[i] | (self.part[i] != self.part[j]))
        i, j = i[keep], j[keep]
        need = -(-self.percent * (self.n[i] + self.n[j]) // (100 + self.percent))
        # at the first shared shingle everything shared comes at or behind both places
        keep = np.minimum(self.n[i] - self.pos[i], self.n[j] - self.pos[j]) >= need
        i, j, need = i[keep], j[keep], need[keep]
        apart = np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(1, dtype=np.int64)
        keep = apart <= self.n[i] + self.n[j] - 2 * need
        return i[keep], j[keep]

    def few(self) -> tuple[np.ndarray, np.ndarray]:
        """Each row with the two before it and with the first and the middle one of its run."""
        rows = np.arange(len(self.n))
        middle = self.first + (rows - self.first) // 2
        found = []
        for other in (rows - 1, rows - 2, self.first, middle):
            ok = (other >= self.first) & (other < rows)
            found.append(self.pairs(other[ok], rows[ok]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of separate parts: in each run, every part but the largest against the others."""
        low, high = np.minimum.reduceat(self.comp, self.starts), np.maximum.reduceat(self.comp, self.starts)
        for s, e in zip(self.starts[low != high], self.ends[low != high], strict=True):
            names, part = np.unique(self.comp[s:e], return_inverse=True)
            rank = np.argsort(np.argsort(-np.bincount(part), kind="stable"))[part]
            order = np.argsort(rank, kind="stable")
            rank = rank[order]
            step = max(1, 2_000_000 // (e - s))
            begin = int(np.searchsorted(rank, 1))
            for k in range(begin, e - s, step):
                rows = np.arange(k, min(e - s, k + step))
                upto = np.searchsorted(rank, rank[rows], "left")
                j = np.repeat(rows, upto)
                i = np.arange(len(j)) - np.repeat(np.cumsum(upto) - upto, upto)
                yield self.pairs(s + order[i], s + order[j])


def _candidates(rows: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """Distinct class pairs (a < b) of sorted runs that pass the filters."""

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        runs = _Runs(t, percent)
        for i, j in runs.rest() if all_pairs else [runs.few()]:
            a, b = runs.cls[i], runs.cls[j]
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_pydict({"a": pa.array(pair[:, 0], pa.int64()), "b": pa.array(pair[:, 1], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size >= _RUN_ROWS:
                t = pa.Table.from_batches(held).combine_chunks()
                key = [np.array(t[c]) for c in ("token", "block")]
                inside = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
                cut = int(np.flatnonzero(inside)[-1]) + 1 if inside.any() else 0
                if cut:
                    yield from emit(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
                    size = t.num_rows - cut
        if held:
            yield from emit(pa.Table.from_batches(held).combine_chunks())

    # by size first (the upper half of place)
    ordered = rows.repartition("token", "block").sortWithinPartitions("token", "block", "place", "cls")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist(), strict=True):
                x, y = _unpacked(x), _unpacked(y)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_pydict({"src": batch["a"].filter(mask), "dst": batch["b"].filter(mask)})

    a, b = sets.select(F.col("cls").alias("a"), F.col("set").alias("sa")), sets.select(F.col("cls").alias("b"), F.col("set").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "src long, dst long")


def _row_key(id_col: str, text: str) -> tuple[Column, Column]:
    """What rows are told apart by, as ids may be missing or shared: the id (the least one for null) and a hash of the text."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)), F.xxhash64(F.col(text))


def _labelled(docs: DataFrame, n: int, percent: int, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, key, n, cls) of every row of ``docs``, and what (cls, id, key, rows, total, least, of) is known of each class.

    ``id`` and ``key`` are a class's first row, ``rows`` counts the rows that repeat it, ``total`` all,
    ``of`` is the first class reachable by links (itself included) and ``least`` the id of its
    first row, so no step gathers a component. cls is null for the empty set.
    """
    spark = docs.sparkSession
    small_batches(spark)
    row_id, key = _row_key(id_col, text)
    own = docs.select(row_id.alias("id"), key.alias("key"), F.col(text).alias("text"))
    every = _sets(own, n, percent)
    worded = every.filter("cls is not null")
    first = worded.groupBy("cls", "id", "key").agg(F.count(F.lit(1)).alias("rows"), F.min("grp").alias("grp"), F.min("bits").alias("bits"))
    classes = stored(spark, first.groupBy("cls").agg(F.min(F.struct("id", "key", "rows")).alias("one"), F.sum("rows").alias("total"), F.min("grp").alias("grp"), F.min("bits").alias("bits")).select("cls", "one.*", "total", "grp", "bits"), "classes")
    groups = worded.groupBy("grp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), (F.min("cls") != F.max("cls")).alias("many"))
    # a row is a shingle, a group, and in one number the set's size, the place and whether the group has several classes
    place = F.shiftleft("n", 32) + F.col("pos") * 2 + F.col("many").cast("long")
    index = groups.select("grp", "n", "many", F.posexplode("prefix").alias("pos", "token")).select("token", "grp", place.alias("place"))
    # counted before it is joined, so no shingle's groups are gathered
    several = index.groupBy("token").agg(F.count(F.lit(1)).alias("found")).filter("found > 1").select("token", F.lit(True).alias("several"))
    index = index.join(several, "token", "left").filter("several or place % 2 = 1")
    unpacked = F.shiftright(F.col("place").bitwiseAND(F.lit((1 << 32) - 1)), 1)
    index = stored(spark, index.select("token", "grp", unpacked.alias("pos"), F.shiftright("place", 32).alias("n")), "index")
    partners = stored(spark, classes.select("grp", "cls", "bits").join(index.select("grp").distinct(), "grp", "left_semi"), "partners")
    # a run is cut by the number of its classes, which its groups may hold many of
    runs = index.join(partners.groupBy("grp").agg(F.count(F.lit(1)).alias("m")), "grp").groupBy("token").agg(F.sum("m").alias("found"))
    long_runs = stored(spark, runs.filter(F.col("found") > _RUN_ROWS).select("token", F.ceil(F.col("found") / _RUN_ROWS).cast("int").alias("slices")), "runs")

    def expanded(labels: DataFrame | None) -> DataFrame:
        members = partners
        if labels is None:
            members = members.withColumn("comp", F.col("cls"))
        else:
            members = members.join(labels.select(F.col("node.cls").alias("cls"), F.col("component.cls").alias("comp")), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        rows = index.join(members, "grp").join(long_runs, "token", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        low, high = F.least("part", "other").cast("long"), F.greatest("part", "other").cast("long")
        crosses = (F.col("part") != F.col("other")).cast("long")
        # narrow rows: one number for the block of slices, one for the slice, the size and the place
        block = F.shiftleft(low, 32).bitwiseOR(F.shiftleft(high, 1)).bitwiseOR(crosses)
        return rows.select("token", block.alias("block"), "part", F.shiftleft("n", 32).bitwiseOR(F.col("pos")).alias("place"), "cls", "comp", "bits")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, n) for t in b["text"].to_pylist()]
            cls = [np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).astype(np.int64) if len(h) else None for h in sets]
            yield pa.RecordBatch.from_pydict({"cls": pa.array(cls, pa.int64()), "set": pa.array([_packed(h) for h in sets], pa.binary())})

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stored(spark, pairs, "pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "id", "key"), "cls")
        wanted = stored(spark, wanted, "wanted")
        few = wanted.count() <= _BROADCAST_IDS
        rows = wanted.select("id", "key")
        chosen = own.join(F.broadcast(rows) if few else rows, ["id", "key"], "left_semi")
        # rows that repeat id and text give their set more than once
        links = stored(spark, _verify(pairs, chosen.mapInArrow(whole, "cls long, set binary").dropDuplicates(["cls"]), percent), "links")
        # classes are linked in order of their first rows, so a component is called by its first row
        node = wanted.select("cls", F.struct("id", "key", "cls").alias("node"))
        named = links.join(node.select(F.col("cls").alias("src"), F.col("node").alias("a")), "src").join(node.select(F.col("cls").alias("dst"), F.col("node").alias("b")), "dst")
        named = stored(spark, named.select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")
        released(spark, pairs, wanted, links)
        return named

    links = verified(_candidates(expanded(None), percent, False))
    labels = stored(spark, connected_components(spark, links), "labels")
    more = verified(_candidates(expanded(labels), percent, True))
    last = stored(spark, connected_components(spark, links.unionAll(more)), "labels")
    of = last.select(F.col("node.cls").alias("cls"), F.col("component.id").alias("least"), F.col("component.cls").alias("of"))
    known = classes.select("cls", "id", "key", "rows", "total").join(of, "cls", "left")
    known = stored(spark, known.withColumns({"least": F.coalesce("least", "id"), "of": F.coalesce("of", "cls")}), "known")
    released(spark, index, partners, long_runs, links, more, labels, last, classes)
    return every.select("id", "key", "n", "cls"), known


def similarity_groups(docs: DataFrame, *, n: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``: the least id reachable by links."""
    every, known = _labelled(docs, n, percent, id_col, text)
    # most classes are one row without links to lesser ones; only the others are joined
    others = known.filter("total > 1 or least != id").select("cls", "least")
    out = every.join(others, "cls", "left")

    def shown(c: str) -> Column:
        return F.when(F.col(c) != _NULL_ID, F.col(c))

    return out.withColumn("least", F.coalesce("least", "id")).select(shown("id").alias("doc_id"), F.col("n").alias("n_shingles"), shown("least").alias("component_id"))


def one_of_each(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group, that with the least id and then the least hash of its text, and all rows without words.

    Rows that share an id or have none are told apart by their texts; of rows that repeat both, one stays.
    """
    names = docs.columns
    _, known = _labelled(docs, n, percent, "doc_id", "text")
    kept = known.filter("of = cls").select("id", "key", "rows")
    row_id, key = _row_key("doc_id", "text")
    # the white space that words are split at
    worded = F.coalesce(F.col("text").rlike(r"[^ \t\n\r\x0B\f]"), F.lit(False))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("d"), row_id.alias("id"), key.alias("key"), worded.alias("worded"))
    joined = own.filter("worded").join(kept, ["id", "key"])
    single = joined.filter("rows = 1").select("d.*")
    repeated = joined.filter("rows > 1").dropDuplicates(["id", "key"]).select("d.*")
    return single.unionAll(repeated).unionAll(own.filter("not worded").select("d.*"))
