"""A compressed FM-index over word sequences, and matching statistics by backward search.

The index keeps the Burrows-Wheeler transform of some sequences in a wavelet tree (laid out
level by level), so the range of suffixes that start with ``c`` + P follows from the range of P by
counting ``c`` in front of its two ends. Suffixes are sorted by their first words only, as many
as the least length of interest needs. A pattern is read from its end to its start; once it has
the least length, the range of all but its last word is looked up, so the window one place to the
left costs one more step. A step that finds nothing starts again, one word further to the left.

Each range of suffixes with equal windows carries the least owner (a document's id), so a search
tells not only that a window occurs but whether an earlier owner has it.
"""

from __future__ import annotations

import io

import numpy as np
import zstandard


class _Bits:
    """Bit rows of equal length with constant-time ranks."""

    def __init__(self, packed: np.ndarray) -> None:
        self.words = packed
        self.sums = np.zeros(packed.shape, np.uint32)
        np.cumsum(np.bitwise_count(packed)[:, :-1], axis=1, out=self.sums[:, 1:])

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        """Bits as 64-bit words, with at least one word behind the last bit."""
        room = np.zeros((len(bits) // 64 + 1) * 64, bool)
        room[: len(bits)] = bits
        return np.packbits(room, bitorder="little").view(np.uint64)

    def rank(self, row: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.sums[row, word] + np.bitwise_count(self.words[row, word] & below)


def _ranks(codes: np.ndarray, least: int) -> dict[int, np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, up to ``least`` or more; places behind the end count as 0."""
    ranks, h = {1: codes}, 1
    while h < least:
        now = ranks[h].astype(np.int64)
        later = np.zeros_like(now)
        later[: max(len(now) - h, 0)] = now[h:] + 1
        ranks[2 * h] = np.unique(now * (int(now.max(initial=0)) + 2) + later, return_inverse=True)[1].astype(np.int32)
        h *= 2
    return ranks


def _changes(ranks: dict[int, np.ndarray], order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix differs in its first ``depth`` words from the one before it in the order."""
    differs, at = np.zeros(len(order), bool), 0
    differs[:1] = True
    for h in sorted(ranks, reverse=True):
        if depth - at >= h:
            r = np.zeros(len(order), np.int64)
            r[: max(len(order) - at, 0)] = ranks[h][at:].astype(np.int64) + 1
            differs[1:] |= r[order[1:]] != r[order[:-1]]
            at += h
    return differs


class FMIndex:
    """Sequences of 64-bit words, searched for windows of ``least`` words."""

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.parts = parts
        self.symbols, self.mins = parts["symbols"], parts["mins"]
        self.least, self.n = (int(x) for x in parts["sizes"])
        self.bits = _Bits(parts["tree"])
        self.zeros = self.n - np.array([int(self.bits.rank(k, np.array([self.n]))[0]) for k in range(len(parts["tree"]))])
        ends = np.unpackbits(parts["ends"].view(np.uint8), axis=1, bitorder="little")[:, : self.n].view(bool)
        self.outer, self.inner = (np.flatnonzero(e) for e in ends)
        counts = parts["counts"]
        every = np.arange(len(counts))
        self.base = np.cumsum(counts) - counts - self._down(every, np.zeros(len(counts), np.int64))

    @classmethod
    def build(cls, sequences: list[np.ndarray], owners: np.ndarray, least: int) -> FMIndex:
        """An index of the sequences; ``owners`` has one number a sequence."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        symbols, inverse = np.unique(np.concatenate(sequences), return_inverse=True)
        # a 0 behind each sequence; no pattern holds one
        n = int(lengths.sum() + len(lengths))
        codes, owner = np.zeros(n, np.int32), np.repeat(owners, lengths + 1)
        inside = np.ones(n, bool)
        inside[np.cumsum(lengths + 1) - 1] = False
        codes[inside] = inverse + 1
        ranks = _ranks(codes, least)
        order = np.argsort(ranks[max(ranks)], kind="stable")
        x = codes[order - 1]
        levels = max(1, len(symbols).bit_length())
        tree = []
        for k in range(levels - 1, -1, -1):
            bit = (x >> k & 1).astype(bool)
            tree.append(_Bits.pack(bit))
            x = np.concatenate([x[~bit], x[bit]])
        outer, inner = _changes(ranks, order, least - 1), _changes(ranks, order, least)
        parts = {
            "symbols": symbols, "counts": np.bincount(codes, minlength=len(symbols) + 1), "tree": np.stack(tree), "ends": np.stack([_Bits.pack(outer), _Bits.pack(inner)]),
            "mins": np.minimum.reduceat(owner[order], np.flatnonzero(inner)), "sizes": np.array([least, n]),
        }
        return cls(parts)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.parts)
        return zstandard.ZstdCompressor(level=3).compress(out.getvalue())

    @classmethod
    def from_bytes(cls, data: bytes) -> FMIndex:
        return cls(dict(np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data)))))

    def _down(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places at the tree's lowest level: the code's first one there, and as many further as the code occurs before ``at``."""
        for k in range(len(self.zeros)):
            ones = self.bits.rank(k, at)
            at = np.where(code >> (len(self.zeros) - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def step(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of ``code`` + P from those of P; empty where it doesn't occur."""
        both = self._down(np.concatenate([code, code]), np.concatenate([low, high]))
        return self.base[code] + both[: len(code)], self.base[code] + both[len(code) :]

    def least_owners(self, patterns: list[np.ndarray]) -> list[np.ndarray]:
        """For each pattern and each of its windows, in order, the least owner of the window, or the greatest number if no sequence holds it."""
        none = np.iinfo(np.int64).max
        lengths = np.array([len(p) for p in patterns], np.int64)
        flat = np.concatenate([*patterns, np.zeros(0, np.uint64)]).astype(np.uint64)
        code = np.minimum(np.searchsorted(self.symbols, flat), max(len(self.symbols) - 1, 0))
        code = np.where(self.symbols[code] == flat, code + 1, 0)
        first = np.cumsum(lengths) - lengths
        out = np.full(len(flat), none)
        # one entry a pattern: where it starts, where its present match ends, and the match itself
        live = np.flatnonzero(lengths >= self.least)
        start, end = first[live], (first + lengths)[live]
        at, low, high, depth = end.copy(), np.zeros(len(live), np.int64), np.full(len(live), self.n), np.zeros(len(live), np.int64)
        while len(start):
            at -= 1
            c = code[at]
            low, high = self.step(c, low, high)
            depth += 1
            found = (high > low) & (c > 0)
            whole = found & (depth == self.least)
            if whole.any():
                l = low[whole]
                out[at[whole]] = self.mins[np.searchsorted(self.inner, l, "right") - 1]
                # without its last word
                k = np.searchsorted(self.outer, l, "right") - 1
                low[whole], high[whole] = self.outer[k], np.append(self.outer, self.n)[k + 1]
                depth[whole] -= 1
            end = end - (whole | ~found)
            lost = ~found
            at[lost], low[lost], high[lost], depth[lost] = end[lost], 0, self.n, 0
            on = end - start >= self.least
            if not on.all():
                start, end, at, low, high, depth = (v[on] for v in (start, end, at, low, high, depth))
        return [out[a : a + n - self.least + 1] if n >= self.least else out[:0] for a, n in zip(first, lengths, strict=True)]
