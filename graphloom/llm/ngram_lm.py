"""Language-model scoring: interpolated modified Kneser-Ney trigrams as memory-mapped sorted hash arrays.

Counting: each task counts the trigrams u v w of its documents (two start marks before the first
token, an end token behind the last) and hands them on in packed blocks by the middle word's
shard. There all u and w of a v meet, so a shard adds up, without another shuffle, the trigrams'
counts, the totals and follower numbers of contexts (u, v), the numbers of different words before
each pair (v, w), and its part of the words' own numbers, which are additive and go on to the
words' shards. A word more frequent than a mean shard would overload one; a first pass over all
texts finds these words (there are at most twice as many as shards), and their trigrams are spread
over several shards by the last word; only their contexts then have parts in several shards,
which are added up in the second step. The same pass lists common words, a fixed number at most,
which blocks name by rank instead of by hash; that changes the blocks' size alone. All arrays are written as files below the shared folder,
which workers map into memory; nothing of the model but these two lists passes the driver.

Scoring: p(w | u v) = max(c(u v w) - D, 0) / c(u v) + backoff(u v) p(w | v), where p(w | v) is the
same formula over numbers of different words before (v, w), and p(w) over numbers of different
words before w, backed off to 1 / (V + 1) for each word and any unknown one. The discounts D for
counts 1, 2 and 3 or more are, at each level, the usual estimates from counts of counts.

Keys: words by 56 bits of their hash; pairs and trigrams by a shard, then a bucket of about 16 keys,
then 32 bits, so a missing one is taken for another with a chance of about 4 in 10^9.

Defined cases: a null or empty text is the end token alone; rows with null id are held out
(their crc32 is null, so they teach nothing); repeated rows count each; with nothing to learn
from, every token is unknown with probability 1; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import freed_shuffles, new_path, remove_path, small_batches
from graphloom.llm.token_files import SEPARATOR

#: Word hashes have 56 bits; the top ones are the shard.
_BITS = 56
_START, _END = 1, 2
#: Tokens that a task counts at once, and the longest piece of a text among them: together below 2^21, so three word ranks fit one key.
_FLUSH, _PIECE = 1_900_000, 100_000
_RANK = 21
#: Words that blocks name by rank, and how often one of a task's ``_FLUSH`` tokens must be a word for the task to propose it.
_COMMON, _PROPOSED = 1 << 17, 6
_MAGIC = 0x4B4E4C4D
RESULT = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
_RESULT = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text (A-Z in lower case) and of the end token."""
    words = text.encode().lower().split() if text else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(64 - _BITS)
    return np.append(h, np.uint64(_END))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two hashes, in order."""
    h = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shards:
    """Which shard holds what follows a middle word: the word's own, or one of several by the last word if it is frequent.

    Also how blocks name words: ``common`` ones, most frequent first, by their rank.
    """

    def __init__(self, bits: int, frequent: dict[int, int], common: list[int]) -> None:
        self.bits = bits
        self.common = np.array(common, np.uint64)
        self.rank = np.argsort(self.common, kind="stable").astype(np.int32)
        self.words = np.array(sorted(frequent), np.uint64)
        self.ways = np.array([frequent[int(w)] for w in self.words], np.uint64)

    def ways_of(self, v: np.ndarray) -> np.ndarray:
        """In how many shards the words are: 1 for all but the frequent ones."""
        out = np.ones(len(v), np.uint64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, v), len(self.words) - 1)
            hit = self.words[at] == v
            out[hit] = self.ways[at[hit]]
        return out

    def of(self, v: np.ndarray, w: np.ndarray, ways: np.ndarray) -> np.ndarray:
        own = v >> np.uint64(_BITS - self.bits)
        return (own + (w * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) % ways) & np.uint64((1 << self.bits) - 1)

    def ordered(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of distinct words, the common ones by rank, then the others by hash, and the ranks of the former."""
        hit = np.zeros(len(words), bool)
        at = np.zeros(len(words), np.int64)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, words, sorter=self.rank), len(self.common) - 1)
            at = self.rank[at]
            hit = self.common[at] == words
        known, other = np.flatnonzero(hit), np.flatnonzero(~hit)
        known = known[np.argsort(at[known], kind="stable")]
        return np.concatenate([known, other[np.argsort(words[other], kind="stable")]]), at[known]

    def named(self, ranks: np.ndarray, others: np.ndarray) -> bytes:
        """A list of words: common ones by ascending ranks, then others by ascending hashes."""
        return _joined([_planes(np.diff(ranks, prepend=0)), _planes(np.diff(others, prepend=np.uint64(0)), 8)])

    def words_of(self, b: bytes) -> np.ndarray:
        ranks, others = _parted(b, 2)
        return np.concatenate([self.common[np.cumsum(_unplaned(ranks))], np.cumsum(_unplaned(others, 8), dtype=np.uint64)])

    def key(self, shard: np.ndarray, h: np.ndarray) -> np.ndarray:
        return (shard << np.uint64(64 - self.bits)) | (h >> np.uint64(self.bits))


def summed(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct keys in order, the columns' sums for each, and the place of a row of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], [np.add.reduceat(c[order], at) if len(at) else c[:0] for c in columns], order[at]


def _planes(x: np.ndarray, width: int = 4) -> bytes:
    """Numbers byte plane by byte plane, which compresses well where most are small."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes())


def _unplaned(b: bytes, width: int = 4) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").ravel()


def _joined(parts: list[bytes]) -> bytes:
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def _parted(block: bytes, n: int) -> list[bytes]:
    ends = np.cumsum(struct.unpack_from(f"<{n}I", block)) + 4 * n
    return [block[s:e] for s, e in zip([4 * n, *ends[:-1]], ends, strict=True)]


def pack(shards: Shards, words: np.ndarray, ranks: np.ndarray, v: np.ndarray, w: np.ndarray, u: np.ndarray, counts: np.ndarray) -> bytes:
    """Trigrams sorted by ``v``, whose members are places in the ordered ``words``: the words that occur, runs of v, then w, u and counts."""
    here = np.zeros(len(words), bool)
    here[v] = here[w] = here[u] = True
    place = np.cumsum(here) - 1
    at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    names = shards.named(ranks[here[: len(ranks)]], words[len(ranks) :][here[len(ranks) :]])
    return _joined([names, *map(_planes, (np.diff(place[v[at]], prepend=0), np.diff(np.append(at, len(v))), place[w], place[u], counts))])


def unpack(shards: Shards, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, w, counts) of a packed block."""
    names, *rest = _parted(block, 6)
    words, (steps, runs, w, u, counts) = shards.words_of(names), map(_unplaned, rest)
    return words[u], np.repeat(words[np.cumsum(steps)], runs), words[w], counts.astype(np.int64)


def _parts(shards: Shards, kind: int, keys: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Additive rows of the second step with distinct keys: their kind (0 words, 1 contexts), keys and columns."""
    order, ranks = shards.ordered(keys) if kind == 0 else (np.argsort(keys, kind="stable"), np.zeros(0, np.int64))
    return struct.pack("<II", kind, len(columns)) + _joined([shards.named(ranks, keys[order][len(ranks) :]), *(_planes(c[order], 8) for c in columns)])


def _parts_back(shards: Shards, raw: bytes) -> tuple[int, np.ndarray, list[np.ndarray]]:
    kind, n = struct.unpack_from("<II", raw)
    keys, *columns = _parted(raw[8:], n + 1)
    return kind, shards.words_of(keys), [_unplaned(c, 8).astype(np.int64) for c in columns]


def _table(kind: int, shard: int, bits: int, keys: np.ndarray, columns: list[np.ndarray], facts: tuple[int, ...]) -> bytes:
    """One file block: header, facts, then arrays, each a multiple of 8 bytes: bucket bounds, keys, row codes, and the columns' values for each code.

    ``keys`` are distinct, in order, and begin with the shard's bits. Few combinations of
    column values differ, so a row only holds the number of its own. Words (kind 3) keep whole keys.
    """
    rows = np.stack(columns, axis=1) if len(keys) else np.zeros((0, len(columns)), np.int64)
    if len(columns) == 1:
        values, codes = np.unique(rows[:, 0], return_inverse=True)
        values = values[:, None]
    else:
        h = rows[:, 0].astype(np.uint64)
        for k in range(1, rows.shape[1]):
            h = mixed(h, rows[:, k].astype(np.uint64))
        _, first, codes = np.unique(h, return_index=True, return_inverse=True)
        values = rows[first]
    codes = codes.astype("<u1" if len(values) <= 1 << 8 else "<u2" if len(values) <= 1 << 16 else "<u4")
    if kind == 3:
        bounds, short = np.zeros(0, "<u4"), keys.astype("<u8")
    else:
        k = max(1, len(keys).bit_length() - 4)
        bucket = keys << np.uint64(bits) >> np.uint64(64 - k)
        bounds = np.searchsorted(bucket, np.arange((1 << k) + 1, dtype=np.uint64)).astype("<u4")
        short = (keys << np.uint64(bits + k) >> np.uint64(32)).astype("<u4")
    arrays = [bounds, short, codes, *(values[:, c].astype("<i8") for c in range(len(columns)))]
    head = struct.pack("<IIII", _MAGIC, kind, shard, len(arrays)) + struct.pack("<8Q", *facts, *[0] * (8 - len(facts)))
    body = []
    for a in arrays:
        raw = a.tobytes()
        body.append(struct.pack("<QQ", len(a), a.itemsize) + raw + b"\0" * (-len(raw) % 8))
    content = b"".join(body)
    return head + struct.pack("<Q", len(content)) + content


def counts_of_counts(c: np.ndarray) -> tuple[int, ...]:
    return tuple(int((c == k).sum()) for k in (1, 2, 3, 4))


def discounts(n: tuple[int, ...]) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more: the usual estimate, or half the count where that isn't between 0 and the count.

    So each context leaves something to its unseen words, also where few counts are 1, as in a
    table of copies, and no probability is 0.
    """
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0 for k in (1, 2, 3)]
    return np.array([0.0] + [d if 0 < d < k else k / 2 for k, d in enumerate(raw, 1)])


def _pieces(text: str | None) -> Iterator[np.ndarray]:
    """The tokens of a text in pieces, each behind the two tokens (or start marks) before it."""
    t = np.concatenate([np.array([_START, _START], np.uint64), token_hashes(text)])
    for at in range(0, len(t) - 2, _PIECE):
        yield t[at : at + _PIECE + 2]


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The pieces of all texts in lists of about ``_FLUSH`` tokens."""
    pieces, size = [], 0
    for b in batches:
        for text in b["text"].to_pylist():
            for p in _pieces(text):
                pieces.append(p)
                size += len(p) - 2
                if size >= _FLUSH:
                    yield pieces
                    pieces, size = [], 0
    if pieces:
        yield pieces


def survey(docs: DataFrame, bits: int) -> Shards:
    """The words to spread over several shards, and those that blocks name by rank.

    A word with more than the mean shard's share of all tokens is spread. A task reports words
    that hold half that share of a part of its tokens. What a word has in other parts is less
    than half a share of all, so half a share among what is reported keeps every such word, and
    at most twice as many words as there are shards pass the test. Tasks propose common words,
    too, of which the ``_COMMON`` most frequent are taken.
    """
    half = 2 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _flushes(batches):
            words, n = np.unique(np.concatenate([p[2:] for p in pieces]), return_counts=True)
            top = (n * half >= n.sum()) | (n >= _PROPOSED)
            yield pa.RecordBatch.from_pydict({"word": pa.array([None, *words[top].tolist()], pa.int64()), "n": pa.array([int(n.sum()), *n[top].tolist()], pa.int64())})

    sums = docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).persist()
    try:
        total = sum(r["n"] for r in sums.filter("word is null").collect())
        top = sums.filter(F.col("n") * half >= (total or 1)).filter("word is not null").collect()
        common = [r["word"] for r in sums.filter("word is not null").orderBy(F.desc("n"), "word").limit(_COMMON).collect()]
    finally:
        sums.unpersist()
    # an end token is never in the middle, but a start mark is, once for each end
    ways = {_START if r["word"] == _END else r["word"]: -(-(2 * r["n"] + (total >> bits)) * (1 << bits) // (2 * total)) for r in top}
    return Shards(bits, ways, common)


def _count(docs: DataFrame, shards: Shards) -> DataFrame:
    """Packed trigram counts (shard, block) of the documents, counted within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _flushes(batches):
            words, at = np.unique(np.concatenate(pieces), return_inverse=True)
            order, ranks = shards.ordered(words)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words, at = words[order], rank[at]
            ends = np.cumsum([len(p) for p in pieces])
            token = np.ones(len(at), bool)
            for k in (0, 1):
                token[np.concatenate([[0], ends[:-1]]) + k] = False
            i = np.flatnonzero(token)
            keys, counts = np.unique(at[i - 1] << (2 * _RANK) | at[i] << _RANK | at[i - 2], return_counts=True)
            v, w, u = keys >> (2 * _RANK), keys >> _RANK & ((1 << _RANK) - 1), keys & ((1 << _RANK) - 1)
            shard = shards.of(words[v], words[w], shards.ways_of(words)[v])
            order = np.argsort(shard, kind="stable")
            shard, v, w, u, counts = (x[order] for x in (shard, v, w, u, counts))
            start = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            for s, e in zip(start, np.append(start[1:], len(shard)), strict=True):
                block = pack(shards, words, ranks, v[s:e], w[s:e], u[s:e], counts[s:e])
                yield pa.RecordBatch.from_pydict({"shard": pa.array([int(shard[s])], pa.int64()), "block": pa.array([block], pa.binary())})

    return docs.mapInArrow(run, "shard long, block binary")


def _written(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write file blocks by kind; nothing needs the write's shuffle once it is done."""
    with freed_shuffles(spark):
        df.select("kind", F.col("part").cast("string").alias("value")).write.partitionBy("kind").text(path, lineSep=SEPARATOR.decode())


def _followers(n: np.ndarray) -> list[np.ndarray]:
    """1 where a number is 1, 2, or more."""
    return [(n == 1).astype(np.int64), (n == 2).astype(np.int64), (n >= 3).astype(np.int64)]


def _trigram_shard(shards: Shards):
    def add(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        rows = [unpack(shards, b) for b in table["block"].to_pylist()]
        u, v, w, c = (np.concatenate([r[k] for r in rows]) for k in range(4))
        del rows
        at_shard = np.uint64(shard)
        keys, (c,), place = summed(shards.key(at_shard, mixed(mixed(u, v), w)), [c])
        u, v, w = u[place], v[place], w[place]
        out = [("trigrams", _table(0, shard, shards.bits, keys, [c], (int(c.sum()), *counts_of_counts(c))))]
        del keys
        split = shards.ways_of(v) > 1
        contexts, sums, place = summed(mixed(u, v), [c, *_followers(c)])
        whole = ~split[place]
        keys = shards.key(at_shard, contexts[whole])
        order = np.argsort(keys, kind="stable")
        out.append(("contexts", _table(1, shard, shards.bits, keys[order], [x[whole][order] for x in sums], ())))
        if not whole.all():
            out.append(("parts", _parts(shards, 1, contexts[~whole], [x[~whole] for x in sums])))
        pairs, (before,), place = summed(shards.key(at_shard, mixed(v, w)), [np.ones(len(v), np.int64)])
        out.append(("pairs", _table(2, shard, shards.bits, pairs, [before], counts_of_counts(before))))
        # what the second words give to their own shards, and the middle words' followers to theirs
        firsts, seconds = v[place], w[place]
        last, (preceding,), _ = summed(seconds, [np.ones(len(seconds), np.int64)])
        _, (seen,), _ = summed(w, [c])
        middle, sums, _ = summed(firsts, [before, *_followers(before)])
        none = [np.zeros(len(middle), np.int64)] * 2, [np.zeros(len(last), np.int64)] * 4
        columns = [np.concatenate(x) for x in zip([preceding, seen, *none[1]], [*none[0], *sums], strict=True)]
        words, columns, _ = summed(np.concatenate([last, middle]), columns)
        out.append(("parts", _parts(shards, 0, words, columns)))
        return pa.Table.from_pydict({"kind": [k for k, _ in out], "part": pa.array([_framed(k, p) for k, p in out], pa.binary())})

    return add


def _framed(kind: str, part: bytes) -> bytes:
    return struct.pack("<Q", len(part)) + part if kind == "parts" else part


def _split_parts(shards: Shards):
    """Blocks of additive rows by their keys' shard, from the files of the first step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b["content"].to_pylist():
                at = 0
                while at < len(content):
                    size = struct.unpack_from("<Q", content, at)[0]
                    kind, keys, columns = _parts_back(shards, content[at + 8 : at + 8 + size])
                    at += 8 + size + len(SEPARATOR)
                    shard = keys >> np.uint64((64 if kind else _BITS) - shards.bits)
                    order = np.argsort(shard, kind="stable")
                    shard, keys, columns = shard[order], keys[order], [c[order] for c in columns]
                    start = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                    for s, e in zip(start, np.append(start[1:], len(keys)), strict=True):
                        block = _parts(shards, kind, keys[s:e], [c[s:e] for c in columns])
                        yield pa.RecordBatch.from_pydict({"shard": pa.array([int(shard[s])], pa.int64()), "block": pa.array([block], pa.binary())})

    return run


def _parts_shard(shards: Shards):
    def add(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        rows: dict[int, list] = {0: [], 1: []}
        for b in table["block"].to_pylist():
            kind, keys, columns = _parts_back(shards, b)
            rows[kind].append((keys, columns))
        out = []
        for kind, parts in rows.items():
            if not parts:
                continue
            keys, columns, _ = summed(np.concatenate([p[0] for p in parts]), [np.concatenate(c) for c in zip(*(p[1] for p in parts), strict=True)])
            if kind:
                out.append(("split_contexts", _table(4, shard, shards.bits, keys, columns, ())))
            else:
                before = columns[0]
                facts = (int((before > 0).sum()), int(before.sum()), *counts_of_counts(before), int((before >= 3).sum()))
                out.append(("words", _table(3, shard, shards.bits, keys, columns, facts)))
        return pa.Table.from_pydict({"kind": [k for k, _ in out], "part": pa.array([p for _, p in out], pa.binary())})

    return add


def count_model(spark: SparkSession, docs: DataFrame, text: str = "text") -> tuple[str, Shards]:
    """Count the model of ``docs`` into files; returns their folder and the shards."""
    small_batches(spark)
    rows = docs.select(F.col(text).alias("text"))
    bits = max(6, (2 * max(1, rows.rdd.getNumPartitions()) - 1).bit_length())
    shards = survey(rows, bits)
    path = new_path(spark, "lm")
    _written(spark, _count(rows, shards).groupBy("shard").applyInArrow(_trigram_shard(shards), "kind string, part binary"), f"{path}/a")
    if _exists(spark, f"{path}/a/kind=parts"):
        files = spark.read.format("binaryFile").load(f"{path}/a/kind=parts").filter("length > 0").select("content")
        added = files.mapInArrow(_split_parts(shards), "shard long, block binary").groupBy("shard").applyInArrow(_parts_shard(shards), "kind string, part binary")
        _written(spark, added, f"{path}/b")
        remove_path(spark, f"{path}/a/kind=parts")
    return path, shards


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _share(spark: SparkSession, path: str) -> str:
    """A local path of the model's files in every worker: the shared folder's own, or a copy that Spark fetches."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return url.path
    spark.sparkContext.addFile(path, recursive=True)
    return "files:" + path.rsplit("/", 1)[1]


class Model:
    """The mapped arrays of all shards, and the probabilities from them."""

    def __init__(self, path: str, shards: Shards) -> None:
        if path.startswith("files:"):
            path = SparkFiles.get(path[6:])
        self.shards = shards
        self.tables: list[dict[int, list[np.ndarray]]] = [{} for _ in range(5)]
        facts = np.zeros((5, 8), np.int64)
        for folder, _, names in sorted(os.walk(path)):
            if "kind=" not in folder or folder.endswith("kind=parts"):
                continue
            for name in sorted(n for n in names if n.startswith("part-") and os.path.getsize(f"{folder}/{n}")):
                data = np.memmap(f"{folder}/{name}", np.uint8, "r")
                at = 0
                while at < len(data):
                    magic, kind, shard, n = struct.unpack_from("<IIII", data, at)
                    if magic != _MAGIC:
                        raise ValueError("not a model file")
                    facts[kind] += np.frombuffer(data[at + 16 : at + 80], "<i8")
                    size = struct.unpack_from("<Q", data, at + 80)[0]
                    place, arrays = at + 88, []
                    for k in range(n):
                        length, width = struct.unpack_from("<QQ", data, place)
                        arrays.append(data[place + 16 : place + 16 + length * width].view(f"<{'i' if k > 2 else 'u'}{width}"))
                        place += 16 + length * width + -(length * width) % 8
                    self.tables[kind][shard] = arrays
                    at += 88 + size + len(SEPARATOR)
        self.n_tokens, self.n_words, self.n_pairs = int(facts[0][0]), int(facts[3][0]), int(facts[3][1])
        self.d3, self.d2, self.d1 = (discounts(tuple(f)) for f in (facts[0][1:5], facts[2][:4], facts[3][2:6]))
        once, twice, more = int(facts[3][2]), int(facts[3][3]), int(facts[3][6])
        self.left_over = (self.d1[1] * once + self.d1[2] * twice + self.d1[3] * more) / self.n_pairs if self.n_pairs else 1.0

    def _find(self, kind: int, keys: np.ndarray, columns: int) -> list[np.ndarray]:
        """The columns' values for each key; 0 where a key is missing."""
        keys, back = np.unique(keys, return_inverse=True)
        out = [np.zeros(len(keys), np.int64) for _ in range(columns)]
        bits = self.shards.bits
        shard = (keys >> np.uint64((_BITS if kind == 3 else 64) - bits)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(keys) else []
        for s, e in zip(at, np.append(at[1:], len(keys)), strict=True):
            mine = self.tables[kind].get(int(shard[s]))
            if mine is None or not len(mine[1]):
                continue
            bounds, short, codes, *values = mine
            last = len(short) - 1
            if kind == 3:
                place = np.searchsorted(short, keys[s:e])
                hit = short[np.minimum(place, last)] == keys[s:e]
            else:
                k = (len(bounds) - 1).bit_length() - 1
                bucket = (keys[s:e] << np.uint64(bits) >> np.uint64(64 - k)).astype(np.int64)
                wanted = (keys[s:e] << np.uint64(bits + k) >> np.uint64(32)).astype(np.uint32)
                place, end = bounds[bucket].astype(np.int64), bounds[bucket + 1].astype(np.int64)
                high = end.copy()
                for _ in range(int((end - place).max()).bit_length()):
                    mid = (place + high) >> 1
                    less = (short[np.minimum(mid, last)] < wanted) & (place < high)
                    high = np.where(less, high, np.minimum(mid, high))
                    place = np.where(less, mid + 1, place)
                hit = (place < end) & (short[np.minimum(place, last)] == wanted)
            code = codes[place[hit]]
            for o, x in zip(out, values, strict=True):
                o[s:e][hit] = x[code]
        return [o[back] for o in out]

    def score(self, texts: list[str | None]) -> list[dict]:
        if not texts:
            return []
        tokens = [token_hashes(t) for t in texts]
        sizes = np.array([len(t) for t in tokens])
        starts = np.cumsum(sizes) - sizes
        w = np.concatenate(tokens)
        v = np.concatenate([[np.uint64(_START)], w[:-1]]).astype(np.uint64)
        v[starts] = _START
        u = np.concatenate([[np.uint64(_START)], v[:-1]]).astype(np.uint64)
        u[starts] = _START
        before, seen, *_ = self._find(3, w, 6)
        _, _, total2, *few2 = self._find(3, v, 6)
        ways = self.shards.ways_of(v)
        shard = self.shards.of(v, w, ways)
        n = self._find(2, self.shards.key(shard, mixed(v, w)), 1)[0]
        uv = mixed(u, v)
        total3, *few3 = self._find(1, self.shards.key(self.shards.of(v, w, np.ones(len(v), np.uint64)), uv), 4)
        split = ways > 1
        if split.any():
            for mine, theirs in zip([total3, *few3], self._find(4, uv[split], 4), strict=True):
                mine[split] = theirs
        c = self._find(0, self.shards.key(shard, mixed(uv, w)), 1)[0]
        p = np.maximum(before - self.d1[np.minimum(before, 3)], 0) / max(self.n_pairs, 1) + self.left_over / (self.n_words + 1)
        for count, total, few, d in ((n, total2, few2, self.d2), (c, total3, few3, self.d3)):
            some = np.maximum(total, 1)
            backoff = np.where(total > 0, sum(d[k + 1] * few[k] for k in range(3)) / some, 1.0)
            p = np.maximum(count - d[np.minimum(count, 3)], 0) / some + backoff * p
        base = np.log10((seen + 0.1) / (self.n_tokens + 0.1 * (self.n_words + 1)))
        known, base, score = (np.add.reduceat(x, starts) for x in ((seen > 0).astype(np.int64), base, np.log10(p)))
        return [
            {"n_tokens": int(k), "n_known": int(a), "train_tokens": self.n_tokens, "base_score": float(b), "score": float(s)}
            for k, a, b, s in zip(sizes, known, base, score, strict=True)
        ]


_MODELS: dict[str, Model] = {}


def score_texts(spark: SparkSession, model: tuple[str, Shards], text: Column) -> Column:
    """A struct column (n_tokens, n_known, train_tokens, base_score, score) for a text column."""
    small_batches(spark)
    path, shards = _share(spark, model[0]), model[1]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if path not in _MODELS:
            _MODELS.clear()
            _MODELS[path] = Model(path, shards)
        for texts in batches:
            rows, part, size = [], [], 0
            for t in texts.to_pylist():
                part.append(t)
                size += len(t or "")
                if size > 4_000_000:
                    rows += _MODELS[path].score(part)
                    part, size = [], 0
            yield pa.array(rows + (_MODELS[path].score(part) if part else []), _RESULT)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, RESULT).asNondeterministic()(text)
