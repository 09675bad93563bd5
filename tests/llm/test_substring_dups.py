"""Substring dedup against a plain version: the given table, many shards, split anchors, odd rows; and the index alone."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import substring_dups
from graphloom.llm.fm_index import FMIndex
from graphloom.llm.queries import QUERIES


def plain(docs, window=50):
    """(doc_id, n_words, n_removed, kept) of each row; a null id is the least."""
    key = {i: -(1 << 63) if i is None else i for i, _ in docs}
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t) if t else []) for i, t in docs]
    least: dict[tuple, int] = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, key[i]), key[i])
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < key[i]:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", substring_dups.n_removed(), "kept").collect()), key=str)


def test_given_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in plain(docs)]
    assert any(w[2] for w in want)
    got = QUERIES["op13_substring_dedup"](spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def _planted(seed, n=150):
    """Copies, near copies, one passage in a third of the texts with other words around it, periodic and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]

    def some(k):
        return [rng.choice(vocabulary) for _ in range(k)]

    passage, base = some(70), some(150)
    docs = []
    for k in range(n):
        kind = k % 6
        if kind in (0, 1):
            w = some(rng.randint(0, 40)) + passage + some(rng.randint(0, 40))
        elif kind == 2:
            w = base if rng.random() < 0.5 else [x if rng.random() > 0.02 else rng.choice(vocabulary) for x in base]
        elif kind == 3:
            w = some(2) * rng.randint(10, 300)
        else:
            w = some(rng.randint(0, 120))
        docs.append((k, rng.choice([" ", "\n", "  \t"]).join(w)))
    rng.shuffle(docs)
    return docs + docs[:5] + [(docs[0][0], docs[1][1]), (None, docs[2][1]), (None, docs[3][1]), (10**6, docs[2][1])]


@pytest.mark.parametrize(("window", "gram", "shard_words"), [(50, 8, 1 << 20), (50, 8, 300), (12, 3, 150), (5, 8, 2000)])
def test_shards_and_split_anchors(spark, window, gram, shard_words):
    docs = _planted(window + shard_words)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(substring_dups.remove_repeats(df, window=window, gram=gram, shard_words=shard_words)) == plain(docs, window)


def test_odd_rows(spark):
    long = " ".join(f"w{k % 700}" for k in range(30_000))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "short"), (5, long), (6, long + " more"), (7, "é\x00\x85x " * 60), (8, "x " + "é\x00\x85x " * 60), (None, None), (9, "É " * 49)]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in ("id", "th", "anchor", "seg", "spans", "start", "shard")))
    assert found(substring_dups.remove_repeats(df)) == plain(docs)
    assert substring_dups.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("least", [1, 2, 3, 7, 50])
def test_index(least):
    """Windows of sequences, of strangers and of mixtures, after a round trip through bytes."""
    rng = np.random.default_rng(least)
    for trial in range(10):
        source = rng.integers(0, 3, 400).astype(np.uint64) << np.uint64(60)
        sequences = [source[a : a + n] for a, n in zip(rng.integers(0, 300, 8), rng.integers(1, 3 * least + 4, 8), strict=True)]
        owners = rng.integers(-9, 99, 8)
        strangers = [rng.integers(0, 5, n).astype(np.uint64) << np.uint64(60) for n in rng.integers(0, 4 * least, 4)]
        patterns = sequences[:4] + strangers + [np.concatenate([sequences[0], strangers[0], sequences[1]]), source]
        want: dict[bytes, int] = {}
        for s, o in zip(sequences, owners.tolist(), strict=True):
            for k in range(len(s) - least + 1):
                w = s[k : k + least].tobytes()
                want[w] = min(want.get(w, o), o)
        got = FMIndex.from_bytes(FMIndex.build(sequences, owners, least).to_bytes()).least_owners(patterns)
        for p, g in zip(patterns, got, strict=True):
            assert g.tolist() == [want.get(p[k : k + least].tobytes(), np.iinfo(np.int64).max) for k in range(max(0, len(p) - least + 1))]


def test_anchors_follow_content():
    """A window has the same anchor wherever it stands."""
    rng = np.random.default_rng(3)
    rarity = rng.integers(0, 3, 1 << 10).astype(np.uint8)
    shared = rng.integers(0, 2**63, 60).astype(np.uint64)
    seen = []
    for _ in range(5):
        before = rng.integers(0, 2**63, rng.integers(0, 90)).astype(np.uint64)
        anchor, start, n = substring_dups.segments(np.concatenate([before, shared, before]), rarity, 50, 8)
        at = len(before) + np.arange(11)
        seen.append(anchor[np.searchsorted(start, at, "right") - 1].tolist())
        assert (np.append(start[1:], start[-1] + n[-1] - 49) == start + n - 49).all()
    assert all(s == seen[0] for s in seen)
