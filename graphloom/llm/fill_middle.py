"""Fill-in-the-middle: texts cut in three at unit borders and put together in another order.

A unit is a word with the white space before it, or the white space at a text's end. So a unit
ends where a character that isn't white space meets one that is, and at the text's end: whether
it does can be told from two neighbouring characters. Texts are cut into chunks that overlap by
one character, and all chunks of a batch count the ends they hold side by side, in one vector
operation. A running sum over the counts says which chunk holds a cut's rank, and only the two
chunks that hold a text's two cuts are read again for the place. Nothing is shuffled: a row's
chunks are counted by the task that has read its text.

Defined cases: a null text counts as empty, and an empty text is plain with 0 units; a text that
holds a sentinel is plain; a null id is drawn for as an empty one; repeated rows give repeated
results; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import by_size, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters of a chunk.
CHUNK = 4096
_OUT = "text string, n long, form string, prefix_chars long, middle_chars long, output string"


def _ends(points: np.ndarray) -> np.ndarray:
    """Whether a unit ends between each character and the next."""
    space = (points == 32) | (points - np.uint32(9) < 5)
    return ~space[:-1] & space[1:]


class Chunks:
    """Overlapping chunks of some texts, and how many units end inside each text before each chunk."""

    def __init__(self, texts: list[str], size: int = CHUNK) -> None:
        self.points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.length = np.array([len(t) for t in texts], np.int64)
        self.at = np.cumsum(self.length) - self.length
        per_text = -(-self.length // size)
        # chunk by chunk: the text's number, the first character, the character behind the last one
        owner = np.repeat(np.arange(len(texts)), per_text)
        self.first = np.cumsum(per_text) - per_text
        nth = np.arange(len(owner)) - self.first[owner]
        self.start = self.at[owner] + nth * size
        self.end = np.minimum(self.start + size, self.at[owner] + self.length[owner])
        ends = np.append(_ends(self.points), False) if len(self.points) else np.zeros(0, bool)
        # no end lies between two texts
        ends[(self.at + self.length - 1)[self.length > 0]] = False
        counts = np.add.reduceat(ends, self.start, dtype=np.int64) if len(owner) else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.last = self.first + per_text
        inside = self.before[self.last] - self.before[self.first]
        #: Units of each text; its last one ends with it.
        self.n = inside + (self.length > 0)

    def offset(self, k: int, rank: int) -> int:
        """Characters in the first ``rank`` units of text ``k``."""
        if rank == 0 or rank == self.n[k]:
            return int(self.length[k]) if rank else 0
        wanted = rank + self.before[self.first[k]]
        chunk = int(np.searchsorted(self.before[: self.last[k] + 1], wanted)) - 1
        here = _ends(self.points[self.start[chunk] : self.end[chunk] + 1])
        return int(self.start[chunk] + np.flatnonzero(here)[wanted - self.before[chunk] - 1] + 1 - self.at[k])


def rearranged(text: str, form: str, cuts: tuple[int, int]) -> str:
    prefix, middle, suffix = text[: cuts[0]], text[cuts[0] : cuts[1]], text[cuts[1] :]
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """(id, text, n, form, prefix_chars, middle_chars, output) of every row.

    ``percent`` of the documents are changed, ``spm_percent`` of these with the suffix first; all
    draws come from the hash of seed and id, so a rerun gives the same output.
    """
    small_batches(docs.sparkSession)
    key = docs.schema[id_col]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    drawn = [F.conv(digest.substr(8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    given = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), *drawn)

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for part in by_size(b["text"].to_pylist()):
                texts = [t or "" for t in part]
                rows, chunks = [], Chunks(texts, chunk)
                h1, h2, h3, h4 = (b[f"h{k}"][done : done + len(part)].to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4))
                for k, t in enumerate(texts):
                    n = int(chunks.n[k])
                    if not t or PREFIX in t or SUFFIX in t or MIDDLE in t or h3[k] % 100 >= percent:
                        rows.append((t, n, "plain", None, None, t))
                        continue
                    form = "spm" if h4[k] % 100 < spm_percent else "psm"
                    a, z = sorted((int(h1[k] % (n + 1)), int(h2[k] % (n + 1))))
                    cuts = chunks.offset(k, a), chunks.offset(k, z)
                    rows.append((t, n, form, cuts[0], cuts[1] - cuts[0], rearranged(t, form, cuts)))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                made = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
                ids = b["id"][done : done + len(part)]
                done += len(part)
                yield pa.RecordBatch.from_arrays([ids, *made], names=["id", "text", "n", "form", "prefix_chars", "middle_chars", "output"])

    return given.mapInArrow(change, f"id {key.dataType.simpleString()}, {_OUT}").withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text before the change, from output and form alone; a changed text holds each sentinel once."""
    out = F.col(output)

    def between(first: str, second: str) -> Column:
        return F.split_part(F.split_part(out, F.lit(first), F.lit(2)), F.lit(second), F.lit(1))

    middle = F.split_part(out, F.lit(MIDDLE), F.lit(2))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    return F.when(F.col(form) == "spm", spm).when(F.col(form) == "psm", psm).otherwise(out)
