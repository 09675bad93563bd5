"""Fill-in-the-middle against a plain version, with chunks of a few characters, and on its edge cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import fill_middle

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = ["", None, " ", "a", " a", "a ", "  a\t\nb  ", "\U0001f600 \U0001f600x \U0001f600", "<P> a b", "a < b <", "x\x00y z \x85 w\xa0v", "ab " * 5000]
TEXTS += ["ab " * k + " c" for k in range(40)] + ["S> <M >P>" * k + " <" for k in range(8)] + ["<S>", "a <M> b"]


def plain(i, text):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, n, "plain", None, None, text
    return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("chunk", [1, 2, 7, 4096])
def test_against_plain(spark, chunk):
    given = [(k, t) for k, t in enumerate(TEXTS * 3)] + [(None, "no id here at all"), (3, "again"), (3, "again")]
    # clashing names, and an id that isn't a long
    docs = spark.createDataFrame(given, "doc_id int, text string").select("*", *(F.lit("x").alias(c) for c in ("id", "n", "h1", "form", "output")))
    out = fill_middle.fill_in_middle(docs, chunk=chunk)
    assert dict(out.dtypes)["doc_id"] == "int"
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_middle.restored().alias("back")).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((plain(*d) for d in given), key=str)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in given)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_empty_table(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shares(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    n = {r["form"]: r["count"] for r in fill_middle.fill_in_middle(docs, percent=90, spm_percent=50).groupBy("form").count().collect()}
    assert abs(n["plain"] - 2000) < 200 and abs(n["spm"] - n["psm"]) < 400
