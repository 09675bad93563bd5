"""The thin queries over whole small tables, held against brute force or SQL."""

import os

import duckdb
import pytest

import corpus_pipeline
from graphloom.llm.queries import ORACLES, QUERIES
from tests.llm import brute

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def source(spark, sf_dir, name, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols).collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert rows(QUERIES[name](spark, sf_dir), *names) == sorted(cur.fetchall())


def test_language_on_held_out_rows(spark, sf_dir):
    truth = {r[0]: r[1] for r in source(spark, sf_dir, "documents", "doc_id", "lang")}
    out = QUERIES["op1_language_id"](spark, sf_dir).collect()
    held = [r for r in out if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(out) == len(truth) and all(0 <= r["score"] <= 1 for r in out)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_secrets(spark, sf_dir):
    docs = source(spark, sf_dir, "documents", "doc_id", "text")
    got = {r["doc_id"]: r for r in QUERIES["op2_secret_scan"](spark, sf_dir).collect()}
    for i, text in docs:
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == brute.base_spans(text)


def test_tokens(spark, sf_dir):
    import public_tokenizers

    docs = source(spark, sf_dir, "documents", "doc_id", "text")
    got = rows(QUERIES["op3_token_files"](spark, sf_dir), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == brute.token_rows(docs, public_tokenizers.path("byte_bpe_50k.json"))


def test_embeddings(spark, sf_dir):
    want = brute.vector_rows(source(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    got = rows(QUERIES["op4_embedding_near_dups"](spark, sf_dir), "vec_id", "n_links", "component_id", "kept")
    assert len(got) == len(want) and sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_chats(spark, sf_dir):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = source(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text") + [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = rows(QUERIES["op5_chat_format"](spark, sf_dir), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert got == brute.chat_rows(turns)


def test_lm(spark, sf_dir):
    want = brute.lm_rows(source(spark, sf_dir, "documents", "doc_id", "text"))
    got = rows(QUERIES["op7_lm_score"](spark, sf_dir), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-6)


def test_similarity(spark, sf_dir):
    docs = source(spark, sf_dir, "documents", "doc_id", "text")
    assert rows(QUERIES["op9_ngram_join"](spark, sf_dir), "doc_id", "n_shingles", "component_id") == brute.similarity_rows(docs, 3, 90)


def test_pipeline(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, texts = docs.columns, dict(source(spark, sf_dir, "documents", "doc_id", "text"))
    lang = corpus_pipeline.identify_language(spark, docs, sf_dir)
    assert lang.columns == names
    near = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert near.columns == names
    assert rows(near, "doc_id") == sorted({(c,) for _, _, c in brute.similarity_rows(list(texts.items()), 5, 80)})
    # the whole: what language ID keeps goes through plain versions of the four other stages
    kept = {r["doc_id"]: r["text"] for r in lang.collect()}
    sources = dict(source(spark, sf_dir, "documents", "doc_id", "source"))
    least = {i: c for i, _, c in brute.similarity_rows(list(kept.items()), 5, 80)}
    one = {i: t for i, t in kept.items() if least[i] == i}
    windows = brute.windows([t for _, t in source(spark, sf_dir, "benchmark", "item_id", "text")])
    clean = {i: t for i, t in one.items() if not brute.contaminated(t, windows)}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, source varchar, text varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(i, sources[i], t) for i, t in clean.items()])
    cur = con.execute(ORACLES["op6_source_mix"])
    at = {c[0]: k for k, c in enumerate(cur.description)}
    copies = {r[at["doc_id"]]: r[at["taken"]] // r[at["size"]] if r[at["size"]] else 0 for r in cur.fetchall()}
    repeated = [(i, texts[i]) for i in sorted(copies) for _ in range(copies[i])]
    want = brute.token_rows(repeated, public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want


def test_no_hidden_limits():
    assert len(QUERIES) == 13 and all(os.path.basename(f.__code__.co_filename) == "queries.py" for f in QUERIES.values())
