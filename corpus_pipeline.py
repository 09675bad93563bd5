"""A training-data pipeline: five stages, each one of the corpus operators, over ``documents``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, language_id, mixing, ngram_join, token_files
from graphloom.llm.common import new_path, released, stored, table

#: No stage's result can be stated in SQL as a whole (a trained network, similarity joins).
ORACLE_SQL: str | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; what has no letter, or fits none, goes.

    Null, empty and letterless texts are rejected; rows with null lang teach nothing but are
    judged as any other; repeated rows and rows with a null id get the same verdict as their text;
    without any labelled row every text is rejected; columns pass through, clashing names too.
    """
    names = docs.columns
    marked = docs.withColumn("__lang", language_id.predict(language_id.fit(docs), docs, F.col("text")))
    return marked.filter((F.col("__lang.lang") != "und") & (F.col("__lang.score") >= 0.4)).select(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles with a similarity of 0.8 or more.

    The one with the least id stays (a null id counts as the least), ties go to the least hash of
    the text; of rows that repeat id and text one stays; rows without words link with nothing and
    all stay.
    """
    return ngram_join.one_of_each(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate.

    Null and wordless texts are clean; each of repeated rows is judged alike; null ids don't
    matter; an empty benchmark, or one of null texts, leaves every document.
    """
    names = docs.columns
    marked = docs.withColumn("__hits", decontaminate.contamination(table(spark, sf_dir, "benchmark"), F.col("text")))
    return marked.filter(~decontaminate.is_contaminated("__hits")).select(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Documents without words are never taken; a null source is a source of its own; repeated rows
    are documents of their own; ties in the order go by id, then size.
    """
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what is read back from them: one row a document, repeats included.

    A null text is the end token alone; a null id comes first; repeated ids follow one another.
    """
    path = new_path(spark, "tokens")
    token_files.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, path, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
    ("token_files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each one's result written and read again; a step goes once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs, old = stored(spark, stage(spark, docs, sf_dir), name), docs
        if k:
            released(spark, old)
    return STAGES[-1][1](spark, docs, sf_dir)
