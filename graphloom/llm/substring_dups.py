"""Substring dedup: words that repeat a window of an earlier document, found by FM-indexes of shards.

A window is a fixed number of consecutive words. Each word covered by a window goes if the same
window starts in a document with a smaller id as well; all windows are judged on the input.

Which documents have to be searched against which index is settled by content, so that work
grows with the corpus and not with its square. The anchor of a window is its rarest short run of
words, by a sketch of fixed width over all documents and then by hash; equal windows have equal
anchors. Consecutive windows with one anchor make a segment. Only anchors that documents of
different ids hold can bear a repeated window; equal segments are folded into one, called by its
least document, and only its words are fetched and sent to the anchor's shard. As a window takes
the rarest anchor in it, a frequent passage that goes on differently in each document has
frequent anchors only for the windows within it, and those are equal and fold.

Each shard is written as a compressed FM-index, and the segments are then streamed through it:
matching statistics by backward search give, for each window, the least document that has it.
Shards have about ``shard_words`` words; an anchor with more is cut into several indexes by
hash, and each of its segments visits them all, in slices. Copies of a segment in later
documents are covered as a whole, as their first one shows each of their windows.

Words are compared as 64-bit hashes: that two windows differ and count as equal takes a collision
in every word in which they differ.

Defined cases: null texts have no words; a null id counts as the least; documents with one id
take nothing from one another; repeated rows give repeated results; an empty table gives an empty
result; other columns are never read. The sketch only affects cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import by_size, released, small_batches, stored
from graphloom.llm.fm_index import FMIndex

#: Slots of the rarity sketch, one byte each in every worker.
SKETCH = 1 << 20
#: Words of an anchor, and the most windows of a segment.
GRAM, MOST_WINDOWS = 8, 200
#: Words of a shard's index.
SHARD_WORDS = 1 << 20
_NULL_ID = -(1 << 63)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words between the ASCII white space characters, unchanged."""
    return text.encode().split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def grams(h: np.ndarray, gram: int) -> np.ndarray:
    """One hash for each ``gram`` consecutive words."""
    total = np.zeros(max(len(h) - gram + 1, 0), np.uint64)
    for k in range(gram):
        total = (total ^ (total >> np.uint64(31))) * _FACTORS[k % 4] + h[k : k + len(total)]
    total = (total ^ (total >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return total ^ (total >> np.uint64(32))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    done = 1
    while done < width:
        more = min(done, width - done)
        x = np.minimum(x[: len(x) - more], x[more:])
        done += more
    return x


def segments(h: np.ndarray, rarity: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first word, number of words) of the runs of windows with one anchor."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = grams(h, gram)
    ranked = rarity[(g & np.uint64(len(rarity) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | g >> np.uint64(8)
    anchor = _least(ranked, window - gram + 1)
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    ends = np.append(starts[1:], len(anchor))
    if (ends - starts > MOST_WINDOWS).any():
        starts = np.concatenate([np.arange(a, b, MOST_WINDOWS) for a, b in zip(starts, ends, strict=True)])
        ends = np.append(starts[1:], len(anchor))
    return anchor[starts], starts, ends - starts + window - 1


def rarity_sketch(docs: DataFrame, gram: int) -> np.ndarray:
    """How often each slot's runs of words occur in all documents, in powers of 2."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(SKETCH, np.int64)
        for b in batches:
            for t in b["text"].to_pylist():
                found = grams(hashes(words_of(t)), gram)
                np.add.at(slots, (found & np.uint64(SKETCH - 1)).astype(np.int64), 1)
        at = np.flatnonzero(slots)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_pydict({"slot": pa.array(at[k : k + (1 << 16)], pa.int32()), "n": pa.array(slots[at[k : k + (1 << 16)]], pa.int64())})

    # at most one row a slot
    out = np.zeros(SKETCH, np.uint8)
    sums = docs.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("r")).toArrow()
    out[sums["slot"].to_numpy()] = sums["r"].to_numpy()
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())


def _all_segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, seg, id, th, start, len) of every document; seg is the hash of a segment's words."""
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(rarity_sketch(docs, gram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, done = b["id"].to_numpy(), b["th"].to_numpy(), 0
            for texts in by_size(b["text"].to_pylist()):
                made = []
                for k, t in enumerate(texts, done):
                    h = hashes(words_of(t))
                    anchor, start, n = segments(h, sketch.value, window, gram)
                    seg = np.array([xxhash.xxh3_64_intdigest(h[a : a + m].tobytes()) for a, m in zip(start, n, strict=True)], np.uint64)
                    made.append((anchor, seg, np.full(len(start), ids[k]), np.full(len(start), keys[k]), start, n))
                done += len(texts)
                anchor, seg, i, th, start, n = (np.concatenate(c) for c in zip(*made, strict=True))
                yield pa.RecordBatch.from_pydict({"anchor": _signed(anchor), "seg": _signed(seg), "id": pa.array(i, pa.int64()), "th": pa.array(th, pa.int64()), "start": pa.array(start, pa.int32()), "len": pa.array(n, pa.int32())})

    return docs.mapInArrow(run, "anchor long, seg long, id long, th long, start int, len int")


def _fetched(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """The words' hashes of each shared segment, from the text of its first document."""
    wanted = shared.groupBy("id", "th").agg(F.collect_list(F.struct("anchor", "seg", "start", "len", "shard", "parts")).alias("wanted"))
    # rows that repeat id and text count once
    texts = docs.dropDuplicates(["id", "th"]).join(wanted, ["id", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, wanted in zip(b["id"].to_pylist(), b["text"].to_pylist(), b["wanted"].to_pylist(), strict=True):
                h = hashes(words_of(t))
                rows += [{"anchor": w["anchor"], "seg": w["seg"], "id": i, "shard": w["shard"], "parts": w["parts"], "words": h[w["start"] : w["start"] + w["len"]].tobytes()} for w in wanted]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.int64()) for c in ("anchor", "seg", "id", "shard")] + [("parts", pa.int32()), ("words", pa.binary())]))

    return texts.select("id", "text", "wanted").mapInArrow(run, "anchor long, seg long, id long, shard long, parts int, words binary")


def _searched(segs: DataFrame, window: int) -> DataFrame:
    """(anchor, seg, low, high): runs of a segment's windows that a document before its first one has."""
    spark = segs.sparkSession
    part = F.pmod(F.xxhash64("seg"), F.col("parts")).cast("int")

    def build(table: pa.Table) -> pa.Table:
        index = FMIndex.build([np.frombuffer(w.as_py(), np.uint64) for w in table["words"]], table["id"].to_numpy(), window)
        return pa.table({"shard": table["shard"][:1], "parts": table["parts"][:1], "part": table["part"][:1], "index": pa.array([index.to_bytes()], pa.binary())})

    indexes = segs.withColumn("part", part).groupBy("shard", "parts", "part").applyInArrow(build, "shard long, parts int, part int, index binary")
    indexes = stored(spark, indexes, "indexes")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor": [], "seg": [], "low": [], "high": []}
        if left.num_rows and right.num_rows:
            index = FMIndex.from_bytes(left["index"][0].as_py())
            patterns = [np.frombuffer(w.as_py(), np.uint64) for w in right["words"]]
            for anchor, seg, own, owners in zip(right["anchor"].to_pylist(), right["seg"].to_pylist(), right["id"].to_pylist(), index.least_owners(patterns), strict=True):
                hit = np.diff(np.concatenate([[0], (owners < own).astype(np.int8), [0]]))
                for low, high in zip(np.flatnonzero(hit > 0).tolist(), np.flatnonzero(hit < 0).tolist(), strict=True):
                    for name, v in zip(out, (anchor, seg, low, high), strict=True):
                        out[name].append(v)
        return pa.table({"anchor": pa.array(out["anchor"], pa.int64()), "seg": pa.array(out["seg"], pa.int64()), "low": pa.array(out["low"], pa.int32()), "high": pa.array(out["high"], pa.int32())})

    # each index meets each slice of its anchor's segments
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = indexes.withColumn("slice", every)
    right = segs.withColumn("slice", part).withColumn("part", every)
    found = left.groupBy("shard", "parts", "part", "slice").cogroup(right.groupBy("shard", "parts", "part", "slice")).applyInArrow(search, "anchor long, seg long, low int, high int")
    found = stored(spark, found, "found")
    released(spark, indexes)
    return found


def covered(docs: DataFrame, *, window: int = 50, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, th, spans): runs of words, end exclusive, that repeated windows cover, for the texts that have any; ``docs`` has id, th and text."""
    spark = docs.sparkSession
    gram = min(gram, window)
    segs = stored(spark, _all_segments(docs, window, gram), "segments")
    folded = segs.groupBy("anchor", "seg").agg(F.min(F.struct("id", "th", "start", "len")).alias("first"), F.max("id").alias("most"))
    folded = stored(spark, folded.select("anchor", "seg", "first.*", "most"), "folded")
    per_anchor = folded.groupBy("anchor").agg(F.min("id").alias("least"), F.max("most").alias("greatest"), F.sum("len").alias("words")).filter("least != greatest")
    per_anchor = stored(spark, per_anchor.select("anchor", "words"), "anchors")
    shards = max(1, -(-(per_anchor.agg(F.sum("words")).first()[0] or 0) // shard_words))
    # an anchor with more words than a shard has indexes of its own
    parts = F.ceil(F.col("words") / shard_words).cast("int")
    shard = F.when(parts > 1, F.col("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    shared = stored(spark, folded.join(per_anchor, "anchor").withColumns({"shard": shard, "parts": parts}).drop("most", "words"), "shared")
    released(spark, folded, per_anchor)
    fetched = stored(spark, _fetched(docs, shared), "words")
    found = _searched(fetched, window)
    released(spark, fetched)
    ranges = found.groupBy("anchor", "seg").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    known = shared.select("anchor", "seg", F.col("id").alias("first")).join(ranges, ["anchor", "seg"], "left")
    # of a run of windows the last one's words end the run of words; later documents' copies go whole
    end = F.col("start") + F.col("len")
    whole = F.array(F.struct(F.col("start").alias("low"), end.alias("high")))
    parts_of = F.transform("ranges", lambda r: F.struct((F.col("start") + r["low"]).alias("low"), (F.col("start") + r["high"] + window - 1).alias("high")))
    spans = F.when(F.col("id") > F.col("first"), whole).otherwise(parts_of)
    hit = segs.join(known, ["anchor", "seg"]).select("id", "th", F.explode(spans).alias("span"))
    out = stored(spark, hit.groupBy("id", "th").agg(F.sort_array(F.collect_set("span")).alias("spans")), "spans")
    released(spark, segs, shared, found)
    return out


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted spans without overlaps."""
    out: list[tuple[int, int]] = []
    for s in spans or ():
        if out and s["low"] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], s["high"])
        else:
            out.append((s["low"], s["high"]))
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", window: int = 50, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, n_words, removed, kept) of every row: the runs of words that go, and the words that stay, joined by one space."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    spans = covered(own.select("id", "th", "text"), window=window, gram=gram, shard_words=shard_words)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, kept = [], [], []
            for t, s in zip(b["text"].to_pylist(), b["spans"].to_pylist(), strict=True):
                words, gone = words_of(t), merged(s)
                n.append(len(words))
                removed.append([{"low": a, "high": z} for a, z in gone])
                stay, at = [], 0
                for a, z in gone:
                    stay += words[at:a]
                    at = z
                kept.append(b" ".join(stay + words[at:]).decode())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "removed", "kept"],
            )

    joined = own.join(spans, ["id", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, removed array<struct<low:int,high:int>>, kept string").withColumnRenamed("doc_id", id_col)


def n_removed(removed: str = "removed") -> Column:
    """Words in the removed runs."""
    return F.aggregate(removed, F.lit(0).cast("long"), lambda a, s: a + s["high"] - s["low"])
