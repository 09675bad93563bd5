"""Language identification by a bidirectional gated recurrent network over bytes.

The network (two GRUs over the bytes, a softmax at every position) is trained in numpy by
backpropagation through time on a bounded sample of labelled rows. Prediction reads the whole
text in windows that follow one another, labels every byte, and pools the position
probabilities of a document by their mean.

Training takes at most ``docs_a_language`` different texts of each language, those of the least
hash (copies count once, whatever their ids), and ``windows`` windows of each; the bound doesn't
grow with the data. A batch is labelled in parts of bounded size. Defined cases: null text or
text without a letter is ``und`` with score 0; rows with null lang teach nothing; with no
labelled row at all, every text is ``und``; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import by_size, small_batches

RESULT = "lang string, score double"
_RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64())])
_WINDOW, _LANES = 128, 2048


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One GRU: h = (1 - z) n + z h, n = tanh(Wn x + r (Un h + bn)); gates in the order z, r, n."""

    def __init__(self, hidden: int, rng: np.random.Generator) -> None:
        self.h = hidden
        self.w = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        self.b = np.zeros(hidden, np.float32)

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.w, self.u, self.b]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States (T, B, H) of byte numbers (T, B), and what the backward pass needs."""
        H = self.h
        state, states, tape = np.zeros((x.shape[1], H), np.float32), [], []
        for t in range(len(x)):
            a, g = self.w[x[t]], state @ self.u
            zr = _sigmoid(a[:, : 2 * H] + g[:, : 2 * H])
            z, r, q = zr[:, :H], zr[:, H:], g[:, 2 * H :] + self.b
            n = np.tanh(a[:, 2 * H :] + r * q)
            tape.append((state, z, r, q, n))
            state = n + z * (state - n)
            states.append(state)
        return np.stack(states), tape

    def backward(self, x: np.ndarray, tape: list, given: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parameters from the gradients of the states."""
        H = self.h
        dw, du, db = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        back = np.zeros_like(given[0])
        for t in range(len(x) - 1, -1, -1):
            state, z, r, q, n = tape[t]
            d = given[t] + back
            dn = d * (1 - z) * (1 - n * n)
            dz, dr, dq = d * (state - n) * z * (1 - z), dn * q * r * (1 - r), dn * r
            da, dg = np.concatenate([dz, dr, dn], 1), np.concatenate([dz, dr, dq], 1)
            np.add.at(dw, x[t], da)
            du += state.T @ dg
            db += dq.sum(0)
            back = d * z + dg @ self.u.T
        return [dw, du, db]


@dataclass
class Network:
    langs: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray  # (2 H, languages)
    bias: np.ndarray

    @property
    def parameters(self) -> list[np.ndarray]:
        return [*self.forward.parameters, *self.backward.parameters, self.out, self.bias]


def train(windows: list[tuple[bytes, int]], langs: list[str], *, hidden: int = 12, length: int = 64, batch: int = 96, steps: int = 350, rate: float = 0.02, seed: int = 7) -> Network:
    """Fit the network to (bytes, language number) with Adam; every position has the window's label."""
    rng = np.random.default_rng(seed)
    net = Network(langs, Direction(hidden, rng), Direction(hidden, rng), rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    x = np.zeros((len(windows), length), np.uint8)
    for k, (b, _) in enumerate(windows):
        x[k, : len(b)] = np.frombuffer(b[:length], np.uint8)
    y = np.array([lang for _, lang in windows])
    by_lang = [np.flatnonzero(y == k) for k in range(len(langs))]
    m, v = [np.zeros_like(p) for p in net.parameters], [np.zeros_like(p) for p in net.parameters]
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(r, max(1, batch // len(langs))) for r in by_lang if len(r)])
        grads = _gradients(net, x[rows].T, y[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, mk, vk in zip(net.parameters, grads, m, v, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            mk += 0.1 * (g - mk)
            vk += 0.01 * (g * g - vk)
            p -= (now * (mk / (1 - 0.9**step)) / (np.sqrt(vk / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    H = net.forward.h
    hf, tape_f = net.forward.forward(x)
    hb, tape_b = net.backward.forward(x[::-1])
    both = np.concatenate([hf, hb[::-1]], 2)
    logits = both @ net.out + net.bias
    p = np.exp(logits - logits.max(2, keepdims=True))
    p /= p.sum(2, keepdims=True)
    p[:, np.arange(len(y)), y] -= 1
    p /= p.shape[0] * p.shape[1]
    d = p @ net.out.T
    flat = both.reshape(-1, 2 * H)
    return [
        *net.forward.backward(x, tape_f, d[:, :, :H]), *net.backward.backward(x[::-1], tape_b, d[::-1, :, H:]),
        flat.T @ p.reshape(len(flat), -1), p.sum((0, 1)),
    ]


class Labeller:
    """Labels every position of many texts at once, arrays laid out (units, lanes)."""

    def __init__(self, net: Network) -> None:
        self.net, self.h = net, net.forward.h
        H, half = self.h, np.float32(0.5)
        scale = np.concatenate([np.full(2 * H, half), np.ones(H, np.float32)]).astype(np.float32)
        # gates are taken from tanh of half their argument, so one tanh serves both
        self.tables = [np.ascontiguousarray((d.w * scale).T) for d in (net.forward, net.backward)]
        self.us = [np.ascontiguousarray((d.u * scale).T) for d in (net.forward, net.backward)]
        self.bs = [d.b[:, None] for d in (net.forward, net.backward)]

    def _run(self, x: np.ndarray, d: int, into: np.ndarray) -> None:
        """Add this direction's part of the logits at each position of ``x`` (T, lanes) to ``into`` (T, L, lanes)."""
        H, lanes, table, u, b = self.h, x.shape[1], self.tables[d], self.us[d], self.bs[d]
        out = np.ascontiguousarray(self.net.out[d * H : (d + 1) * H].T)
        state = np.zeros((H, lanes), np.float32)
        a, g, part = np.empty((3 * H, lanes), np.float32), np.empty((3 * H, lanes), np.float32), np.empty((len(out), lanes), np.float32)
        for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
            np.take(table, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, state, out=g)
            zr, n = a[: 2 * H], a[2 * H :]
            zr += g[: 2 * H]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            q = g[2 * H :]
            q += b
            q *= zr[H:]
            n += q
            np.tanh(n, out=n)
            state -= n
            state *= zr[:H]
            state += n
            np.matmul(out, state, out=part)
            into[t] += part

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean of the position probabilities of each text (texts, languages)."""
        sums, L = np.zeros((len(texts), len(self.net.langs))), len(self.net.langs)
        sizes = np.array([len(t) for t in texts])
        n = -(-sizes // _WINDOW)
        owner = np.repeat(np.arange(len(texts)), n)
        data = np.frombuffer(b"".join(t.ljust(int(k) * _WINDOW, b"\0") for t, k in zip(texts, n, strict=True)), np.uint8).reshape(-1, _WINDOW)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        filled = np.minimum(_WINDOW, sizes[owner] - place * _WINDOW)
        for lo in range(0, len(data), _LANES):
            x = np.ascontiguousarray(data[lo : lo + _LANES].T).astype(np.intp)
            logits = np.empty((_WINDOW, L, x.shape[1]), np.float32)
            logits[:] = self.net.bias[None, :, None]
            self._run(x, 0, logits)
            self._run(x, 1, logits)
            logits -= logits.max(1, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(1, keepdims=True)
            logits *= (np.arange(_WINDOW)[:, None] < filled[lo : lo + _LANES])[:, None, :]
            np.add.at(sums, owner[lo : lo + _LANES], logits.sum(0).T)
        return sums / np.maximum(sizes, 1)[:, None]


def training_windows(docs: DataFrame, *, lang: str = "lang", text: str = "text", docs_a_language: int = 400, windows: int = 4, length: int = 64) -> tuple[list[tuple[bytes, int]], list[str]]:
    """Windows at hashed places of a bounded sample of the labelled rows of ``docs``."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    different = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h")).collect()}
    langs = sorted(different)
    if not langs:
        return [], []
    # about four times the wanted number of the different texts by their hash, so copies make no share smaller; then copies go, and only the bound is ranked
    every = F.element_at(F.create_map(*(F.lit(v) for k in langs for v in (k, max(1, different[k] // (4 * docs_a_language))))), F.col("lang"))
    at = [F.substring("text", (F.pmod(F.xxhash64("h", F.lit(k)), F.greatest(F.lit(1), F.length("text") - length)) + 1).cast("int"), F.lit(length)) for k in range(windows)]
    chosen = rows.filter(F.pmod("h", every) == 0).select("lang", "h", F.array(*at).alias("w")).groupBy("lang", "h").agg(F.min("w").alias("w"))
    ranked = chosen.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h", F.lit("order")), "h"))).filter(F.col("nth") <= docs_a_language)
    number = {k: i for i, k in enumerate(langs)}
    return sorted((w.encode(), number[r["lang"]]) for r in ranked.select("lang", "w").collect() for w in r["w"] if w), langs


def fit(docs: DataFrame, **options: int) -> Network | None:
    """The network for the labelled rows of ``docs``, or None where no row is labelled."""
    windows, langs = training_windows(docs, **options)
    return train(windows, langs) if windows else None


def predict(net: Network | None, docs: DataFrame, text: Column) -> Column:
    """A struct column (lang, score) for a text column."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller(shared.value) if shared.value else None
        for batch in batches:
            rows = []
            for texts in by_size(batch.to_pylist()):
                part = [{"lang": "und", "score": 0.0} for _ in texts]
                use = [(k, t.encode()) for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if labeller else []
                if use:
                    p = labeller.pooled([t for _, t in use])
                    for (k, _), best, top in zip(use, p.argmax(1), p.max(1), strict=True):
                        part[k] = {"lang": labeller.net.langs[best], "score": min(1.0, float(top))}
                rows += part
            yield pa.array(rows, _RESULT)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, RESULT).asNondeterministic()(text)
