"""Secret scans in DataFrame functions alone: three fixed patterns, and Markov models of characters.

A run of token characters that no pattern covers, or a part of it, is a secret if a character model
of random strings explains it better than one of ordinary identifiers, by the log-likelihood ratio of its
character pairs. What is random depends on the letters and digits that a string draws on, so
there is a pair of models for each alphabet (lower case, upper case, digits and what they
combine to), and a run is judged by those of its own. The models are counted from labelled
samples with Spark: random strings are drawn from hashes of numbers; identifiers are names of
Python's standard library and short words of a bounded sample of documents, alone and joined
(words shorter than any run, so that no key is taken for an identifier). Half of each sample is
held out; the limit of an alphabet and a length lies above all but a thousandth of the held-out identifiers. The fitted
tables have a fixed size.

Spans are (kind, start, end) in code points, end exclusive. Defined cases: a null or empty text
has no spans; repeated rows give repeated results; an empty table gives an empty result; numbers
alone are no secrets, as random and ordinary ones look alike; other columns are never read.
"""

from __future__ import annotations

import importlib
import json
import math
from collections import defaultdict
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds in their order, each with its pattern and the least length of what must be long.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "markov")

_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: What the models judge: runs, and the parts of a run between its separators.
_RUN, _PART = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}+", r"(?<![A-Za-z0-9+])[A-Za-z0-9+]{12,}+"
#: Matches whose places are summed up together.
_CHUNK = 64
SPAN = "array<struct<start: int, end: int, kind: int, text: string>>"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once; an expression inside a lambda would be evaluated for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _spans(text: Column, pattern: str, kind: int, value_of: tuple[int, int] | None = None, holds: tuple[str, ...] = ()) -> Column:
    """All matches of a pattern with their places, from the pieces between them.

    ``value_of`` (group, length) drops matches whose group is shorter than that, after matching,
    so that a dropped match still takes its characters. ``holds`` are lower-case texts one of which is in every
    text with a match, which is quicker to tell. Places are summed up within chunks of
    matches and over the chunks, so many matches in one text cost little more than each does.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    nothing = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["piece"])
        end = begin + F.coalesce(F.length(x["found"]), F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["found"].alias("text"))
        keep = x["found"].isNotNull()
        if value_of:
            keep = keep & (F.length(F.regexp_extract(x["found"], pattern, value_of[0])) >= value_of[1])
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def local(all_pairs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(all_pairs) / _CHUNK).cast("int") - 1), lambda c: F.slice(all_pairs, c * _CHUNK + 1, _CHUNK))
        return F.transform(chunks, lambda c: F.aggregate(c, F.struct(F.lit(0).alias("at"), nothing.alias("spans")), step))

    def begins(chunks: Column) -> Column:
        return F.aggregate(chunks, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + c["at"])))

    def moved(c: Column) -> Column:
        return F.transform(c["local"]["spans"], lambda s: F.struct((s["start"] + c["begin"]).alias("start"), (s["end"] + c["begin"]).alias("end"), s["kind"].alias("kind"), s["text"].alias("text")))

    def joined(chunks: Column) -> Column:
        return F.flatten(F.transform(F.filter(F.arrays_zip(chunks.alias("local"), begins(chunks).alias("begin")), lambda c: c["local"].isNotNull()), moved))

    spans = _bound(pairs, lambda p: _bound(local(p), joined))
    may = reduce(lambda a, b: a | b, (F.lower(text).contains(h) for h in holds)) if holds else F.lit(True)
    return F.when(F.coalesce(may & text.rlike(pattern), F.lit(False)), spans).otherwise(nothing)


def base_spans(text: Column) -> Column:
    """The spans of the three fixed patterns, by start, then by kind."""
    every = F.concat(
        _spans(text, ASSIGN, 0, (2, ASSIGN_VALUE), ("passw", "secret", "token", "api")), _spans(text, ACCESS, 1, None, ("akia",)), _spans(text, HEX, 2)
    )
    return _in_order(every)


def _in_order(spans: Column) -> Column:
    return F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"], s["text"]))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text")),
    ).cast(SPAN)


def spans_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Modules whose names are ordinary identifiers.
_MODULES = "argparse ast asyncio collections configparser csv ctypes datetime decimal difflib email functools http inspect io itertools json logging math multiprocessing operator os pathlib pickle random re shutil signal socket sqlite3 ssl statistics string subprocess sys threading time tokenize traceback types typing unittest urllib.parse urllib.request uuid zipfile".split()
#: Lengths from which on a class of lengths begins.
_LENGTHS = (12, 16, 20, 28)


def standard_names() -> list[str]:
    """Names in the standard library, and in its classes."""
    found: set[str] = set()
    for module in map(importlib.import_module, _MODULES):
        for name, value in vars(module).items():
            found.add(name)
            if isinstance(value, type):
                found.update(vars(value))
    return sorted(n.strip("_") for n in found if len(n.strip("_")) > 2)


def _alphabet(token: Column) -> Column:
    """1 for lower case, 2 for upper case and 4 for digits, added up."""
    return sum((F.when(token.rlike(p), w).otherwise(0) for p, w in (("[a-z]", 1), ("[A-Z]", 2), ("[0-9]", 4))), F.lit(0))


def _random_samples(spark: SparkSession, n: int) -> DataFrame:
    """Random strings of every alphabet: hashes of numbers in base 64, 36 and 16, or their letters alone; and numbers."""
    h = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")).cast("binary"), 256)
    base64 = F.base64(F.unhex(h))
    plain, letters = F.regexp_replace(base64, "[+/=]", ""), F.regexp_replace(base64, "[^A-Za-z]", "")
    base36 = F.concat(*(F.conv(F.substring(h, 1 + 12 * k, 12), 16, 36) for k in range(5)))
    each = [base64, plain, letters, F.lower(letters), F.upper(letters), F.lower(base36), F.upper(base36), F.substring(h, 1, 40), F.upper(F.substring(h, 9, 40)), F.regexp_replace(h, "[a-f]", "")]
    lengths = F.element_at(F.array(*map(F.lit, (40, 32, 24, 20, 16, 12))), (F.pmod("id", F.lit(6)) + 1).cast("int"))
    return spark.range(n).select(F.lit(1).alias("label"), F.explode(F.array(*each)).alias("token"), lengths.alias("m")).select("label", F.expr("substring(token, 1, m)").alias("token"))


def _identifier_samples(docs: DataFrame, text: str, n_docs: int) -> DataFrame:
    """Ordinary identifiers: standard names and short words of about ``n_docs`` documents chosen by a hash of the text, alone and joined, in both cases.

    Texts that begin alike are chosen together, so each beginning counts once: a large group of copies
    makes the sample no larger.
    """
    spark = docs.sparkSession
    every = docs.count() // max(1, n_docs) + 1
    chosen = docs.filter(F.pmod(F.xxhash64(F.substring(text, 1, 200)), F.lit(every)) == 0).groupBy(F.substring(text, 1, 200).alias("begin")).agg(F.min(F.substring(text, 1, 4000)).alias("head"))
    # no longer than a run can be short; these are words, as keys of that length aren't judged
    found = F.filter(F.regexp_extract_all("head", F.lit("[A-Za-z][A-Za-z0-9]*"), F.lit(0)), lambda w: F.length(w).between(3, 11) & ~w.rlike("[0-9]"))
    names = spark.range(1).select(F.from_json(F.lit(json.dumps(standard_names())), "array<string>").alias("w"))
    words = chosen.select(found.alias("w")).unionAll(names).filter(F.size("w") > 3)

    def word(i: Column, k: int) -> Column:
        return F.element_at("w", i + k)

    def digit(i: Column) -> Column:
        return (i % 100).cast("string")

    forms = [
        lambda i: word(i, 0), lambda i: F.concat(word(i, 0), F.element_at(F.array(*map(F.lit, "_-/")), (i % 3 + 1).cast("int")), word(i, 1), F.when(i % 5 == 0, F.concat(F.lit("_v"), digit(i))).otherwise("")),
        lambda i: F.concat(word(i, 0), F.initcap(word(i, 1)), F.initcap(word(i, 2)), F.when(i % 4 == 0, digit(i)).otherwise("")),
        lambda i: F.concat_ws("_", word(i, 0), word(i, 1), word(i, 2)), lambda i: F.concat(word(i, 0), word(i, 1)), lambda i: F.concat(F.initcap(word(i, 1)), F.initcap(word(i, 0)), digit(i)),
        lambda i: F.concat(word(i, 0), digit(i), F.lit("-"), word(i, 1), F.lit("-"), word(i, 2)),
    ]
    def form(i: Column) -> Column:
        out = F.when(i % len(forms) == 0, forms[0](i))
        for k, f in enumerate(forms[1:], 1):
            out = out.when(i % len(forms) == k, f(i))
        return out

    tokens = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), form)).alias("token"))
    return tokens.select(F.lit(0).alias("label"), F.explode(F.array("token", F.upper("token"))).alias("token"))


def _shape(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _tables(counts: dict[tuple[int, int, str], int]) -> list[float]:
    """Log-likelihood ratio of each pair of characters in each alphabet, from the numbers of (label, alphabet, pair).

    Random strings have a full table for each alphabet. Identifiers have one for each alphabet of
    what kind of character follows which kind, and one of all alphabets of what letter follows
    what, whatever its case.
    """
    n, table = len(_CHARS), []
    letters: dict[tuple[str, str], int] = defaultdict(int)
    for (label, _, pair), k in counts.items():
        if label == 0 and pair[1].isalpha():
            letters[pair[0].lower() if pair[0].isalpha() else "", pair[1].lower()] += k
    sums: dict[str, int] = defaultdict(int)
    for (a, _), k in letters.items():
        sums[a] += k
    for alphabet in range(8):
        kinds = np.full((4, 4), 0.5)
        drawn = np.zeros((n, n))
        for i, a in enumerate(_CHARS):
            for j, b in enumerate(_CHARS):
                drawn[i, j] = counts.get((1, alphabet, a + b), 0)
                kinds[_shape(a), _shape(b)] += counts.get((0, alphabet, a + b), 0)
        held = drawn.sum(0) > 0
        p = (drawn + 0.5) / (drawn.sum(1, keepdims=True) + 0.5 * max(1, held.sum()))
        kinds /= kinds.sum(1, keepdims=True)
        for i, a in enumerate(_CHARS):
            before = a.lower() if a.isalpha() else ""
            for j, b in enumerate(_CHARS):
                if b.isalpha():
                    follows = (letters[before, b.lower()] + 0.5) / (sums[before] + 13)
                else:
                    follows = 0.1 if b.isdigit() else 0.2
                table.append(round(math.log(p[i, j] / (kinds[_shape(a), _shape(b)] * follows)), 4))
    return table


def fit_models(docs: DataFrame, text: str = "text", *, sample_docs: int = 400, sample_strings: int = 2000, margin: float = 0.12, over: float = 0.001) -> tuple[list[float], list[float]]:
    """(tables, limits): ratios by alphabet and pair, and what a run's ratio for each pair must reach, by alphabet and length.

    At most about ``sample_docs`` documents (their first 4,000 characters) and ``sample_strings``
    random strings in each notation are counted; only counts by pair and the held-out
    identifiers' high ratios come to the driver. A limit is ``margin`` above all but one in
    ``1 / over`` of these.
    """
    spark = docs.sparkSession
    samples = _random_samples(spark, sample_strings).unionAll(_identifier_samples(docs, text, sample_docs))
    samples = samples.select("label", "token", _alphabet(F.col("token")).alias("alphabet"), (F.pmod(F.xxhash64("token"), F.lit(2)) == 1).alias("held_out"))
    pairs = samples.filter("not held_out").select("label", "alphabet", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, 2))).alias("pair"))
    counts = {(r["label"], r["alphabet"], r["pair"]): r["n"] for r in pairs.groupBy("label", "alphabet", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = _tables(counts)
    judged = samples.filter("held_out and label = 0").filter(F.length("token") >= _LENGTHS[0]).distinct()
    ratio = _ratio(F.col("token"), F.from_json(F.lit(json.dumps(table)), "array<double>"), F.col("alphabet")) / (F.length("token") - 1)
    most = {(r["alphabet"], r["k"]): r["most"] for r in judged.groupBy("alphabet", _length_class(F.length("token")).alias("k")).agg(F.percentile(ratio, 1 - over).alias("most")).collect()}
    limits = []
    for alphabet in range(8):
        if alphabet in (0, 4):
            # separators or digits alone
            limits += [1e9] * len(_LENGTHS)
            continue
        for k in range(len(_LENGTHS)):
            seen = [most[alphabet, j] for j in range(k + 1) if (alphabet, j) in most]
            # a length's longer runs are judged no more strictly than its shorter ones
            limits.append(max(0.25, min(seen) + margin) if seen else 0.5)
    return table, limits


def _length_class(n: Column) -> Column:
    return sum((F.when(n >= least, 1).otherwise(0) for least in _LENGTHS[1:]), F.lit(0))


def _ratio(token: Column, table: Column, alphabet: Column) -> Column:
    """The sum of the table's entries over the character pairs of a token of an alphabet."""
    first = alphabet * len(_CHARS) ** 2

    def step(acc: Column, c: Column) -> Column:
        now = F.instr(F.lit(_CHARS), c)
        pair = F.element_at(table, F.greatest(F.lit(1), first + (acc["last"] - 1) * len(_CHARS) + now).cast("int"))
        return F.struct(now.alias("last"), (acc["sum"] + F.when(acc["last"] > 0, pair).otherwise(0.0)).alias("sum"))

    chars = F.filter(F.split(token, ""), lambda c: F.length(c) > 0)
    return F.aggregate(chars, F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of the spans (sorted, they may overlap), so that all places stay."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        begin, end = F.greatest(acc["at"], s["start"]), F.greatest(acc["at"], s["end"])
        return F.struct(end.alias("at"), F.concat(acc["done"], text.substr(acc["at"] + 1, begin - acc["at"]), F.repeat(F.lit(" "), end - begin)).alias("done"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], text.substr(acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def find_secrets(docs: DataFrame, *, text: str = "text", least: float = 9.0) -> DataFrame:
    """``docs`` with a struct column ``secrets`` (base, spans): the fixed patterns' spans, and all spans.

    Outside the spans of the fixed patterns, a run of at least 12 characters joins the spans if its ratio is
    ``least`` or more in all and for each character pair reaches the fitted limit of its alphabet
    and length; of any other run, the parts between its separators (``/ _ = -``) do by the same rule.
    """
    table, limits = fit_models(docs, text)
    table, limits = (F.from_json(F.lit(json.dumps(x)), "array<double>") for x in (table, limits))
    out = docs.withColumn("__body", F.coalesce(F.col(text), F.lit(""))).withColumn("__base", base_spans(F.col("__body")))
    out = out.withColumn("__rest", _blanked(F.col("__body"), F.col("__base"))).withColumn("__runs", _spans(F.col("__rest"), _RUN, 3))

    def is_secret(s: Column) -> Column:
        def judged(alphabet: Column) -> Column:
            limit = F.element_at(limits, (alphabet * len(_LENGTHS) + _length_class(F.length(s["text"])) + 1).cast("int"))
            return _bound(_ratio(s["text"], table, alphabet), lambda ratio: (ratio >= least) & (ratio >= limit * (F.length(s["text"]) - 1)))

        return _bound(_alphabet(s["text"]), judged)

    def parts(run: Column) -> Column:
        own = F.filter(_spans(run["text"], _PART, 3), is_secret)
        return F.transform(own, lambda s: F.struct((s["start"] + run["start"]).alias("start"), (s["end"] + run["start"]).alias("end"), s["kind"].alias("kind"), s["text"].alias("text")))

    def found(run: Column) -> Column:
        # a run without separators has no parts but itself
        return F.when(is_secret(run), F.array(run)).when(run["text"].rlike("[/_=-]"), parts(run)).otherwise(F.array().cast(SPAN))

    spans = F.flatten(F.transform("__runs", found))
    return out.withColumn("secrets", F.struct(F.col("__base").alias("base"), _in_order(F.concat("__base", spans)).alias("spans"))).drop("__body", "__base", "__rest", "__runs")


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    def n(kind: int) -> Column:
        return F.size(F.filter("secrets.base", lambda s: s["kind"] == kind)).cast("long")

    return find_secrets(docs.select("doc_id", "text")).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(spans_text(F.col("secrets.base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("secrets.spans")).alias("spans"),
    )
