"""Trigram counts whose frequent words are split over shards, and texts cut into pieces, against plain dictionaries."""

import random

import pytest

from graphloom.llm import ngram_lm
from graphloom.llm.queries import QUERIES
from tests.llm import brute


@pytest.fixture
def docs(tmp_path, spark):
    rng = random.Random(7)
    names = ["the"] * 30 + ["of", "a"] * 10 + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(names) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    rows += [(1000, "the the the"), (1000, "the the the"), (1001, ""), (1003, "The OF\tthe a\x0bof")]
    rows += [(1004, " ".join(rng.choice(names) if k % 2 else f"x{rng.randrange(5000)}" for k in range(250_000))), (1005, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), rows


def test_frequent_words_are_split_and_counts_stay_exact(spark, docs):
    path, rows = docs
    table = spark.read.parquet(f"{path}/documents.parquet").select("text")
    shards = ngram_lm.survey(table, 6)
    found = dict(zip(shards.words.tolist(), shards.ways.tolist()))
    the = int(ngram_lm.token_hashes("the")[0])
    assert shards.common[0] == the and len(shards.common) > 10
    assert found[the] == -(-(0.5 + 64 * sum(w == "the" for _, t in rows for w in brute.words(t)) / sum(len(brute.words(t)) + 1 for _, t in rows)) // 1) and len(found) <= 2 << 6
    got = sorted(tuple(r) for r in QUERIES["op7_lm_score"](spark, path).collect())
    want = brute.lm_rows(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_pieces_of_a_text_hold_each_trigram_once(monkeypatch):
    monkeypatch.setattr(ngram_lm, "_PIECE", 3)
    text = "a b c d e f g"
    whole = [1, 1, *ngram_lm.token_hashes(text).tolist()]
    cut = [tuple(p[i : i + 3].tolist()) for p in ngram_lm._pieces(text) for i in range(len(p) - 2)]
    assert cut == list(zip(whole, whole[1:], whole[2:]))
    assert [p.tolist() for p in ngram_lm._pieces(None)] == [[1, 1, 2]]


def test_seen_words_score_above_unseen_ones(spark):
    docs = spark.createDataFrame([("a b a c",), ("a b b",), ("c a b",), ("a b a",)], "text string")
    path, shards = ngram_lm.count_model(spark, docs)
    assert ngram_lm._START in shards.words  # one token in four is an end, so start marks are split, too
    model = ngram_lm.Model(path, shards)
    prefix = model.score(["a b"])[0]["score"]
    whole = {w: model.score([f"a b {w}"])[0]["score"] for w in ("a", "b", "c", "unseen")}
    assert all(s < 0 for s in whole.values()) and whole["a"] > whole["c"] > whole["unseen"] and prefix < 0


def test_no_probability_is_zero(spark):
    docs = spark.createDataFrame([("a b c",)] * 4 + [("d e",)] * 2, "text string")
    model = ngram_lm.Model(*ngram_lm.count_model(spark, docs))
    rows = model.score(["a b c", "a b d", "a a a", "unseen words", "", None])
    assert all(-100 < r["score"] < 0 for r in rows) and rows[0]["score"] > rows[1]["score"]
