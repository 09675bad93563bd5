"""Rows that one_of_each keeps where ids are missing or shared."""

from graphloom.llm import ngram_join

TEXTS = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"}


def near(k):
    return f"{TEXTS[k]} {k}end"


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = ngram_join.one_of_each(df)
    assert out.columns == df.columns
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in out.collect())


def test_rows_without_id(spark):
    rows = [(None, TEXTS["a"], "x"), (None, TEXTS["b"], "x"), (None, TEXTS["c"], "y"), (None, TEXTS["c"], "z"), (1, TEXTS["d"], "x"), (None, None, "x"), (None, " ", "x"), (None, None, "y")]
    assert kept(spark, rows) == sorted([(-1, TEXTS["a"]), (-1, TEXTS["b"]), (-1, TEXTS["c"]), (1, TEXTS["d"]), (-1, ""), (-1, " "), (-1, "")])


def test_shared_ids(spark):
    # under id 2 one text is a near copy of document 1 and one is not; id 3 repeats a row; 4 and 5 are near copies
    rows = [(1, TEXTS["a"], "x"), (2, near("a"), "x"), (2, TEXTS["b"], "x"), (3, TEXTS["c"], "x"), (3, TEXTS["c"], "x"), (4, TEXTS["d"], "x"), (5, near("d"), "x")]
    assert kept(spark, rows) == sorted([(1, TEXTS["a"]), (2, TEXTS["b"]), (3, TEXTS["c"]), (4, TEXTS["d"])])


def test_near_copies_without_id(spark):
    rows = [(None, TEXTS["e"], "x"), (None, near("e"), "x"), (None, TEXTS["f"], "x"), (7, near("f"), "x")]
    out = kept(spark, rows)
    assert out in (sorted([(-1, TEXTS["e"]), (-1, TEXTS["f"])]), sorted([(-1, near("e")), (-1, TEXTS["f"])]))
