"""Single properties of the corpus operators, on small fixtures."""

import random
import re
import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import chat, decontaminate, embedding_dups, html_text, language_id, secrets, token_files
from graphloom.llm.common import by_size
from tests.llm import brute


def test_gradients_of_the_network():
    rng = np.random.default_rng(1)
    net = language_id.Network(["a", "b"], language_id.Direction(3, rng), language_id.Direction(3, rng), rng.normal(0, 0.3, (6, 2)).astype(np.float32), np.zeros(2, np.float32))
    for d in (net.forward, net.backward):
        d.w, d.u, d.b = (x.astype(np.float64) for x in (d.w, d.u, d.b))
    net.out, net.bias = net.out.astype(np.float64), net.bias.astype(np.float64)
    x, y = rng.integers(97, 103, (5, 4)), np.array([0, 1, 1, 0])

    def loss():
        hf, hb = net.forward.forward(x)[0], net.backward.forward(x[::-1])[0][::-1]
        z = np.concatenate([hf, hb], 2) @ net.out + net.bias
        return float(np.mean(np.log(np.exp(z).sum(2)) - z[:, np.arange(4), y]))

    for p, g in zip(net.parameters, language_id._gradients(net, x, y), strict=True):
        for at in [tuple(rng.integers(0, k) for k in p.shape) for _ in range(6)] + [(100, *[0] * (p.ndim - 1))] * (len(p) == 256):
            keep, step = p[at], 1e-3
            p[at] = keep + step
            up = loss()
            p[at] = keep - step
            down = loss()
            p[at] = keep
            assert g[at] == pytest.approx((up - down) / (2 * step), rel=0.02, abs=2e-4)


def test_pooling_is_the_mean_over_all_positions():
    rng = np.random.default_rng(2)
    net = language_id.Network(["a", "b", "c"], language_id.Direction(4, rng), language_id.Direction(4, rng), rng.normal(0, 0.5, (8, 3)).astype(np.float32), np.zeros(3, np.float32))
    texts = [bytes(rng.integers(32, 120, n).tolist()) for n in (1, 128, 129, 700)]
    got = language_id.Labeller(net).pooled(texts)
    for t, p in zip(texts, got, strict=True):
        total = np.zeros(3)
        for k in range(0, len(t), 128):
            x = np.frombuffer(t[k : k + 128].ljust(128, b"\0"), np.uint8)[:, None].astype(int)
            both = np.concatenate([net.forward.forward(x)[0], net.backward.forward(x[::-1])[0][::-1]], 2)
            z = np.exp(both @ net.out + net.bias)
            total += (z / z.sum(2, keepdims=True))[: len(t[k : k + 128]), 0].sum(0)
        assert p == pytest.approx(total / len(t), rel=1e-3)


def test_training_sample_is_bounded(spark):
    rows = [(None, "one and the same text", "en")] * 900 + [(k, f"text number {k} is here", "en") for k in range(900)] + [(k, f"texte numero {k} est la", "fr") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    windows, langs = language_id.training_windows(docs, docs_a_language=20, windows=2)
    n = [sum(lang == k for _, lang in windows) for k in range(2)]
    assert langs == ["en", "fr"] and 0 < n[0] <= 40 and 0 < n[1] <= 40
    assert sum(w.startswith(b"one and") for w, _ in windows) <= 2


def test_markov_spans(spark):
    rng = random.Random(5)
    kinds = [string.ascii_letters + string.digits, "0123456789ABCDEF", string.ascii_letters + string.digits + "+/"]
    keys = ["".join(rng.choice(kinds[k % 3]) for _ in range(rng.choice([20, 24, 32, 40]))) for k in range(60)]
    names = [
        "user_profile_settings_v2", "version-1-2-3-beta", "report_2023_final_version", "utf8_general_ci", "sha256sum_check", "Windows10ProInstaller", "covid19-vaccination", "ipv4_address_list",
        "2024-01-05T10-20-30", "4952935900253052", "internationalization", "Donaudampfschifffahrt", "src/main/java/com/example", "MAX_BUFFER_SIZE_BYTES",
    ]
    docs = [(1000 + k, f"see {t} here") for k, t in enumerate(keys)] + [(2000 + k, f"see {t} here") for k, t in enumerate(names)]
    docs += [(3000, f"/home/{keys[0]}/x token=abcdef {keys[3]}")]
    # large enough a corpus that the planted keys don't become its identifiers
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").filter("doc_id < 1000")
    got = {r["doc_id"]: r["spans"] for r in secrets.counted(corpus.unionAll(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    found = [got[1000 + k] == f"markov:4:{4 + len(t)}" for k, t in enumerate(keys)]
    assert sum(found) >= 0.95 * len(keys)
    assert not any(got[2000 + k] for k in range(len(names)))
    # the corpus has no secret but those of the fixed patterns
    assert not any("markov" in s for k, s in got.items() if k < 1000)
    kinds = [x.split(":")[0] for x in got[3000].split(",")]
    assert kinds == ["markov", "assign", "markov"]


def test_many_secrets_in_one_text(spark):
    text = "token=abcdefg, and " * 20_000
    began = time.time()
    r = secrets.counted(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == brute.base_spans(text) and time.time() - began < 60


def test_selective_and_damaged_reads(spark, tmp_path):
    import public_tokenizers

    docs = spark.createDataFrame([(k, f"text of document {k} " * (k % 50)) for k in range(400)] + [(None, "no id"), (7, "again")], "doc_id long, text string")
    path = str(tmp_path / "tokens")
    token_files.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), frame_tokens=500)
    every = {(r["doc_id"], r["start"]): bytes(r["ids"]) for r in token_files.read_token_files(spark, path).collect()}
    assert len(every) == 402 and sorted(s for _, s in every)[0] == 0 and [k for k in every if k[0] is None] == [(None, 0)]
    some = token_files.read_token_files(spark, path, [7, 399]).collect()
    assert sorted(r["doc_id"] for r in some) == [7, 7, 399] and all(every[r["doc_id"], r["start"]] == bytes(r["ids"]) for r in some)
    content = max((p.read_bytes() for p in (tmp_path / "tokens").glob("part-*")), key=len)
    frames, (ids, _) = token_files.seek_table(content)
    assert len(frames) > 2
    broken = bytearray(content)
    broken[frames[0][0] + 12] ^= 0xFF  # in the second frame
    first = next(token_files.documents_of(content))[0]
    with pytest.raises(Exception):  # noqa: B017 - either the frame's own checksum or the table's
        list(token_files.documents_of(bytes(broken)))
    # frames without a wanted document aren't decompressed
    assert [d for d, _, _ in token_files.documents_of(bytes(broken), {first})][0] == first


def chat_of(spark, turns, change=None):
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df)
    return chat.read_back(change(out) if change else out).first()


@pytest.mark.parametrize(
    ("roles", "valid", "refused"),
    [("user assistant", True, None), ("system user assistant user assistant", True, None), ("assistant user", False, 0), ("user user assistant", False, 1), ("user assistant tool assistant", True, None), ("user", False, None), ("user assistant robot", False, 2)],
)
def test_turn_order(spark, roles, valid, refused):
    r = chat_of(spark, [(x, "t") for x in roles.split()])
    assert (r["valid"], r["refused_turn"], r["mask_agrees"]) == (valid, refused, True)


def test_loss_is_read_from_the_flags(spark):
    turns = [("user", "question <|im_end|>"), ("assistant", "answer\\ <|x"), (None, "")]
    r = chat_of(spark, turns)
    assert r["loss_chars"] == len(turns[1][1]) and r["mask_agrees"]
    assert r["formatted_chars"] == sum(len(p) for role, t in turns for _, p, _ in chat.turn_segments(role or "", t))
    wrong = chat_of(spark, turns, lambda s: s.withColumn("loss", (F.col("segment") == 1)))
    assert wrong["loss_chars"] == len(turns[0][1]) and not wrong["mask_agrees"]


def test_several_automata_agree_with_one(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([3, 13, 30])))) for k in range(40)] + [(99, None)]
    texts = [" ".join(rng.choices(words, k=40) + (rng.choice(items[:40])[1].upper().split() if k % 2 else [])) for k in range(60)] + [None, ""]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [sorted(docs.select("doc_id", decontaminate.contamination(bench, F.col("text"), shard_chars=n).alias("r")).collect()) for n in (50_000_000, 500)]
    assert got[0] == got[1] and sum(r["r"]["n_hit"] > 0 for r in got[0]) >= 30


def test_broken_markup_takes_linear_time():
    for bad in ("<a '", '<a "', "<!a", "<div>", "</x><p>a", "<![CDATA["):
        began = time.time()
        html_text.main_text(bad * 50_000)
        assert time.time() - began < 20
    assert html_text.main_text("<p>It's a <b title='x>y'>bold</b> statement, isn't it? Yes, it is.</p>") == "It's a bold statement, isn't it? Yes, it is."


def test_extreme_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1e308, 1.0]), (4, [1.0, -1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dups.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_by_size():
    assert [len(x) for x in by_size(["a" * 3, None, "b" * 9, "c", ""], 5)] == [2, 1, 2] and list(by_size([])) == []


def test_each_stage_of_the_pipeline(spark, sf_dir):
    """Each stage on its own input: what it keeps is what brute force keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    lang = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, sf_dir).collect()}
    lettered = {i for i, t in texts.items() if t and any(map(str.isalpha, t))}
    assert lang <= lettered and len(lang) >= 0.95 * len(lettered)
    items = [brute_words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 13]) for w in items if w for k in range(max(1, len(w) - 12))}
    clean = {i for i, t in texts.items() if not contaminated(brute_words(t), windows)}
    assert {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, sf_dir).collect()} == clean
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()
    sizes = {r[0]: r[1] for r in docs.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).collect()}
    most = max(len(brute.words(t)) for t in texts.values())
    for r in mixed:
        assert r["n"] <= 3 * sizes[r["source"]]
    assert abs(sum(r["n"] for r in mixed) - sum(sizes.values())) <= 3 * most


def brute_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate({c: c + 32 for c in range(65, 91)})) if text else []


def contaminated(words, windows):
    hit = set()
    for n in {len(w) for w in windows}:
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in windows:
                hit.update(range(k, k + n))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_a_language_of_mostly_copies_is_learned(spark):
    """30 different texts and a great many copies of one more teach as much as the 31 texts alone."""
    rng = random.Random(3)
    words = {"en": "the of and to in that was with for they this from".split(), "fi": "ja on ei että se hän oli mutta kun niin minä sinä".split()}
    texts = {k: [" ".join(rng.choices(w, k=40)) for _ in range(31)] for k, w in words.items()}
    rows = [(t, k) for k, ts in texts.items() for t in ts]
    copies = spark.range(200_000).select(F.lit(texts["fi"][0]).alias("text"), F.lit("fi").alias("lang"))
    docs = spark.createDataFrame(rows, "text string, lang string").unionByName(copies)
    windows, langs = language_id.training_windows(docs)
    assert langs == ["en", "fi"] and [sum(k == n for _, k in windows) for n in (0, 1)] == [124, 124]
    assert windows == language_id.training_windows(docs.distinct())[0]
    net = language_id.train(windows, langs)
    found = spark.createDataFrame([(texts[k][5], k) for k in langs], "text string, lang string")
    got = found.select("lang", language_id.predict(net, found, F.col("text")).alias("r")).collect()
    assert all(r["r"]["lang"] == r["lang"] for r in got)
