"""Recall of planted keys by alphabet, clean identifiers, and small tables that hold many keys."""

import random
import string

import pytest

from graphloom.llm import secrets

ALPHABETS = {
    "lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "letters": string.ascii_letters, "lower and digits": string.ascii_lowercase + string.digits,
    "upper and digits": string.ascii_uppercase + string.digits, "all": string.ascii_letters + string.digits, "hex": "0123456789abcdef", "base64": string.ascii_letters + string.digits + "+/",
}
LENGTHS = (16, 20, 24, 32, 40)
WORDS = (
    "user account manager server client request response session database configuration application document translation network connection message service provider system update version release "
    "branch feature report customer order product inventory shipment payment invoice schedule calendar template controller repository transaction validation permission directory folder image "
    "picture gallery video stream player window browser extension plugin module package library function variable constant parameter argument exception handler listener observer factory builder cache buffer queue stack index"
).split()


def _keys(seed, a_kind):
    rng = random.Random(seed)
    return [(kind, "".join(rng.choice(chars) for _ in range(LENGTHS[k % len(LENGTHS)]))) for kind, chars in ALPHABETS.items() for k in range(a_kind)]


def _identifiers(n):
    rng, out = random.Random(11), []
    for k in range(n):
        a, b, c = rng.sample(WORDS, 3)
        forms = [f"{a}_{b}_{c}", f"{a}-{b}-{c}-{k}", a + b.title() + c.title(), f"{a}_{b}_v{k % 7}", f"{a}/{b}/{c}", f"{a}_{b}_{c}".upper(), a + b, f"{2000 + k % 30}-{a}-{b}", f"{rng.randrange(10**15)}", f"{a}{k}"]
        out.append(forms[k % len(forms)])
    return out


@pytest.fixture(scope="module")
def found(spark):
    keys, names = _keys(3, 50), _identifiers(200)
    docs = [(10**6 + k, f"see {t} here") for k, (_, t) in enumerate(keys)] + [(2 * 10**6 + k, f"see {t} here") for k, t in enumerate(names)]
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    return keys, names, {r["doc_id"]: r["spans"] for r in secrets.counted(corpus.unionAll(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}


@pytest.mark.parametrize("kind", list(ALPHABETS))
def test_recall(found, kind):
    keys, _, got = found
    hit = [f":4:{4 + len(t)}" in got[10**6 + k] for k, (own, t) in enumerate(keys) if own == kind]
    assert sum(hit) >= 0.9 * len(hit)


def test_no_identifier_is_a_secret(found):
    _, names, got = found
    assert [n for k, n in enumerate(names) if got[2 * 10**6 + k]] == []


def test_a_small_table_with_many_keys(spark):
    """A table's own keys aren't taught as ordinary identifiers."""
    keys = [t for _, t in _keys(5, 7)][:50]
    docs = [(k, f"the key of this part is {keys[k]} and nothing else" if k < 50 else f"an ordinary line about {WORDS[k % len(WORDS)]} and {WORDS[k // 2 % len(WORDS)]}") for k in range(200)]
    got = {r["doc_id"]: r["spans"] for r in secrets.counted(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(f":24:{24 + len(t)}" in got[k] for k, t in enumerate(keys)) >= 45 and not any(got[k] for k in range(50, 200))
