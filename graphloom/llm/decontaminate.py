"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark.

Text is lower-cased (A-Z only) and cut into words of ASCII letters, digits and any other
non-ASCII character. Every window of ``width`` consecutive words of an item is one pattern of
word numbers; an item of fewer words is one pattern. Each document is scanned once; a word
inside any occurrence is hit, and hit words are mapped back to offsets of the original text.

Defined cases: a null or wordless text has no words and is clean; a null item text has no
pattern; a null item id is called ``null``; repeated items share one pattern and all are
reported; an empty benchmark leaves every document clean; other columns are never read.
"""

from __future__ import annotations

import glob
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import local_path, new_path, small_batches, workers_path

#: ASCII letters to lower case, every other ASCII character but digits to a space.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_RESULT = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("item_ids", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
RESULT = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start: long, end: long>>"


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class Matcher:
    """The automaton of some items; patterns are tuples of word numbers, 0 is any unknown word."""

    def __init__(self, items: list[tuple[str, str]], width: int) -> None:
        patterns: dict[tuple[int, ...], set[str]] = {}
        self.numbers = _Numbers()
        for item, text in items:
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text))
            for i in range(max(1, len(ids) - width + 1)) if ids else ():
                patterns.setdefault(ids[i : i + width], set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for ids, names in patterns.items():
            self.automaton.add_word(ids, (len(ids), names))
        self.shortest = min(map(len, patterns), default=0)
        if patterns:
            self.automaton.make_automaton()

    def scan(self, tokens: list[bytes], hit: np.ndarray, items: set[str]) -> None:
        """Mark the hit words (+1 at a start, -1 behind an end) and add the items found."""
        if not self.shortest or len(tokens) < self.shortest:
            return
        for end, (n, names) in self.automaton.iter(tuple(map(self.numbers.__getitem__, tokens))):
            hit[end - n + 1] += 1
            hit[end + 1] -= 1
            items |= names


def _result(text: str | None, matchers: list[Matcher]) -> dict:
    tokens, items = words(text), set()
    change = np.zeros(len(tokens) + 1, np.int64)
    for m in matchers:
        m.scan(tokens, change, items)
    if not items:
        return {"n_words": len(tokens), "n_hit": 0, "item_ids": [], "spans": []}
    hit = np.concatenate([[False], change[:-1].cumsum() > 0, [False]])
    first, last = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:]) - 1
    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    spans = [{"start": at[i][0], "end": at[j][1]} for i, j in zip(first, last, strict=True)]
    return {"n_words": len(tokens), "n_hit": int(hit.sum()), "item_ids": sorted(items), "spans": spans}


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))


def contamination(
    benchmark: DataFrame, text: Column, *, item: str = "item_id", item_text: str = "text", width: int = 13, shard_chars: int = 50_000_000
) -> Column:
    """A struct column (n_words, n_hit, item_ids, spans) for a text column.

    The benchmark's own size is checked: up to ``shard_chars`` its items are sent to the workers,
    a larger one is dealt over files in the shared folder, and each task builds one shard's
    automaton after the other for a bounded amount of text at a time. So neither the driver nor a worker ever holds
    more than one shard.
    """
    spark = benchmark.sparkSession
    items = _items(benchmark, item, item_text)
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = total // shard_chars + 1
    small_batches(spark)
    if n == 1:
        held = spark.sparkContext.broadcast([tuple(r) for r in items.collect()])
        shards = None
    else:
        path = new_path(spark, "benchmark")
        items.withColumn("k", F.pmod(F.xxhash64("i"), F.lit(n))).repartition("k").write.partitionBy("k").parquet(path)
        held, shards = None, workers_path(spark, path)

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if shards is None:
            one = [Matcher(held.value, width)]
            for texts in batches:
                yield pa.array([_result(t, one) for t in texts.to_pylist()], _RESULT)
            return
        files = sorted(glob.glob(f"{local_path(shards)}/k=*"))
        for texts in _gathered(batches):
            yield pa.array(_scan_in_turn(texts, (Matcher(_read(f), width) for f in files)), _RESULT)

    scan.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scan, RESULT).asNondeterministic()(text)


def _read(folder: str) -> list[tuple[str, str]]:
    found = pq.read_table(folder, columns=["i", "t"], partitioning=None)
    return list(zip(found["i"].to_pylist(), found["t"].to_pylist(), strict=True))


def _gathered(batches: Iterator[pa.Array], chars: int = 32 << 20) -> Iterator[list[str | None]]:
    """The texts of several batches at a time, about ``chars`` characters, so that an automaton is built for more than one batch."""
    held, n = [], 0
    for b in batches:
        texts = b.to_pylist()
        held += texts
        n += sum(len(t) for t in texts if t)
        if n > chars:
            yield held
            held, n = [], 0
    if held:
        yield held


class _Seen:
    """Stands for a matcher whose findings are known already."""

    def __init__(self, change: np.ndarray, items: set[str]) -> None:
        self.change, self.items = change, items

    def scan(self, tokens: list[bytes], hit: np.ndarray, items: set[str]) -> None:
        hit += self.change
        items |= self.items


def _scan_in_turn(texts: list[str | None], matchers: Iterator[Matcher]) -> list[dict]:
    seen = [_Seen(np.zeros(len(words(t)) + 1, np.int64), set()) for t in texts]
    for m in matchers:
        for t, s in zip(texts, seen, strict=True):
            m.scan(words(t), s.change, s.items)
    return [_result(t, [s]) for t, s in zip(texts, seen, strict=True)]


def is_contaminated(result: str) -> Column:
    """The contamination rule: some word is hit, and the hit words are at least 5 % of all."""
    return (F.col(f"{result}.n_hit") > 0) & (20 * F.col(f"{result}.n_hit") >= F.col(f"{result}.n_words"))


def items_digest(result: str) -> Column:
    """Lower-case hex sha256 of the item ids found, sorted as strings and comma-joined."""
    return F.sha2(F.concat_ws(",", F.col(f"{result}.item_ids")), 256)


def digest_of(items: set[str]) -> str:
    """The same digest on the driver, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
