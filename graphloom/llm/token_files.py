"""Token files: independent zstandard frames with a seek table behind them.

A file holds the token ids (little-endian unsigned 32-bit) of consecutive documents in
ascending id order. Its parts, each followed by an empty skippable frame:

    data frames    one zstandard frame for each run of documents, with content checksum
    directory      skippable frame 0x184D2A5D: compressed ids and token counts of the documents
    seek table     skippable frame 0x184D2A5E: compressed size, size and checksum of each data
                   frame, then the number of frames, flags and the magic number 0x8F92EAB1

So a file is a valid zstandard stream, and a reader that wants few documents decompresses only
their frames. Spark's own text writer carries the bytes (its line separator is the empty
skippable frame), so the commit protocol covers retried tasks and any store Spark writes to.

Defined cases: null text is empty text; a null id comes first; repeated ids keep all their
rows, in order of their text's hash, then of the text (so rows that share an id are spread over
the files as any others are); an empty table writes no documents; other columns are never read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches

_DIRECTORY, _SEEK, _END = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
#: An empty skippable frame; all of it is ASCII, so it can be a line separator.
SEPARATOR = b"P*M\x18\x00\x00\x00\x00"
_NULL_ID = -(1 << 63)

#: Characters whose class is beyond doubt; any other text is encoded in one piece.
_LETTER, _NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN = re.compile("[\t\n\x20-\x7e\xa1-\xac\xae-ɏ]*")
#: The byte-level splitting rule of this family of tokenizers (fixed by the format).
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\t\n {_LETTER}{_NUMBER}]+|[\t\n ]+(?![^\t\n ])|[\t\n ]+")
#: Pieces an encoder remembers (some 0.3 KB each) before it starts anew.
_CACHE_PIECES = 300_000


class _Pieces(dict):
    """Piece -> its number; new pieces are kept for the next call of the tokenizer."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """Token ids of texts, equal to the tokenizer's own ``encode(text, add_special_tokens=False)``.

    A byte-level tokenizer without normaliser never merges across the pieces of its splitting
    rule, so each distinct piece is encoded once and remembered. Texts with a special token's
    string or with characters of doubtful class go to the tokenizer whole, as do all texts of
    tokenizers of another kind.
    """

    def __init__(self, path: str) -> None:
        import json

        # a worker has one core; threads for lists of single pieces cost more than they bring
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        pre = kind.get("pre_tokenizer") or {}
        self.by_piece = (
            kind.get("normalizer") is None and kind["model"].get("type") == "BPE" and not kind["model"].get("continuing_subword_prefix")
            and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        )
        special = [t["content"] for t in kind.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.reset()

    def reset(self) -> None:
        self.pieces, self.flat, self.ends = _Pieces(), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self) -> None:
        new, self.pieces.new = self.pieces.new, []
        if new:
            ids: list[int] = []
            ends = []
            for k in range(0, len(new), 1000):
                for e in self.tokenizer.encode_batch_fast(new[k : k + 1000], add_special_tokens=False):
                    ids += e.ids
                    ends.append(len(ids))
            self.flat = np.concatenate([self.flat, np.array(ids, np.uint32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.array(ends, np.int64)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.pieces) > _CACHE_PIECES:
            self.reset()
        out: list[np.ndarray | None] = [None] * len(texts)
        known = []
        for i, t in enumerate(texts):
            if self.by_piece and _PLAIN.fullmatch(t) and not (self.special and self.special.search(t)):
                found = _PIECE.findall(t)
                known.append((i, np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))))
            else:
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
        self._learn()
        for i, n in known:
            starts, sizes = self.ends[n], self.ends[n + 1] - self.ends[n]
            upto = np.cumsum(sizes)
            out[i] = self.flat[np.arange(upto[-1] if len(n) else 0) + np.repeat(starts - upto + sizes, sizes)]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class FileParts:
    """Turns documents into the parts of one file, in order."""

    def __init__(self, frame_tokens: int, level: int) -> None:
        self.frame_tokens, self.compressor = frame_tokens, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.ids: list[int] = []
        self.counts: list[int] = []
        self.frames: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        self.ids.append(_NULL_ID if doc_id is None else doc_id)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.frame_tokens:
            yield self._frame()

    def _frame(self) -> bytes:
        raw = np.concatenate(self.waiting).astype("<u4").tobytes()
        part = self.compressor.compress(raw)
        self.frames.append((len(part) + len(SEPARATOR), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.waiting, self.n_waiting = [], 0
        return part

    def end(self) -> Iterator[bytes]:
        if self.waiting:
            yield self._frame()
        if self.ids:
            listing = np.array([self.ids, self.counts], "<i8").tobytes()
            yield _skippable(_DIRECTORY, self.compressor.compress(listing))
            entries = b"".join(struct.pack("<III", *f) for f in self.frames)
            yield _skippable(_SEEK, entries + struct.pack("<IBI", len(self.frames), 0x80, _END))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 0, frame_tokens: int = 1 << 16, level: int = 3) -> None:
    """Encode the whole text of every document, append ``end_id`` and write the files at ``path``.

    One range shuffle by id orders the documents over the files; tokenizing follows it, so that
    sampling the ranges costs a scan only.
    """
    small_batches(docs.sparkSession)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        enc, file = encoder(tokenizer_path), FileParts(frame_tokens, level)
        end = np.array([end_id], np.uint32)
        for b in batches:
            for doc_id, ids in zip(b["doc_id"].to_pylist(), enc.encode([t or "" for t in b["text"].to_pylist()]), strict=True):
                for part in file.add(doc_id, np.concatenate([ids, end])):
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.binary())})
        for part in file.end():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.binary())})

    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    out = ordered.mapInArrow(parts, "part binary").select(F.col("part").cast("string").alias("value"))
    out.write.option("maxRecordsPerFile", 0).text(path, lineSep=SEPARATOR.decode())


def seek_table(content: bytes) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(compressed size, size, checksum) of each data frame, and the directory as two rows."""
    tail = len(content) - len(SEPARATOR)
    n, _, magic = struct.unpack_from("<IBI", content, tail - 9)
    if magic != _END:
        raise ValueError("not a token file: no seek table at its end")
    at = tail - 9 - 12 * n
    frames = list(struct.iter_unpack("<III", content[at : tail - 9]))
    behind = sum(f[0] for f in frames)
    magic, size = struct.unpack_from("<II", content, behind)
    if magic != _DIRECTORY:
        raise ValueError("not a token file: no directory behind its frames")
    listing = zstandard.ZstdDecompressor().decompress(content[behind + 8 : behind + 8 + size])
    return frames, np.frombuffer(listing, "<i8").reshape(2, -1)


def documents_of(content: bytes, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(id, first token's place in the file, token ids) of all or the wanted documents.

    Frames without a wanted document stay compressed; each read frame's checksum is compared.
    """
    frames, (ids, counts) = seek_table(content)
    starts = np.cumsum(counts) - counts
    decompressor, offset, first = zstandard.ZstdDecompressor(), 0, 0
    place = 0
    for size, raw_size, checksum in frames:
        last = int(np.searchsorted(starts, place + raw_size // 4, "left")) if raw_size else first
        mine = range(first, last)
        if wanted is None or any(int(ids[k]) in wanted for k in mine):
            raw = decompressor.decompress(content[offset : offset + size - len(SEPARATOR)])
            if len(raw) != raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
                raise ValueError("a frame of a token file is damaged")
            tokens = np.frombuffer(raw, "<u4")
            for k in mine:
                if wanted is None or int(ids[k]) in wanted:
                    s = int(starts[k]) - place
                    yield None if ids[k] == _NULL_ID else int(ids[k]), int(starts[k]), tokens[s : s + int(counts[k])]
        offset, place, first = offset + size, place + raw_size // 4, last


def _files(spark: SparkSession, path: str) -> DataFrame:
    number = F.regexp_extract("path", r"part-(\d+)-", 1).cast("long")
    return spark.read.format("binaryFile").load(path).filter("length > 0").select(number.alias("file"), "content")


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) read from the files; ``start`` counts over all files.

    A file's first token is placed by the token counts of the files before it, one row a file.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [int(seek_table(c)[1][1].sum()) for c in b["content"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"file": b["file"], "n": pa.array(n, pa.int64())})

    wanted = None if doc_ids is None else set(doc_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b["file"].to_pylist(), b["content"].to_pylist(), strict=True):
                rows = [(d, s, len(t), zlib.crc32(t.tobytes()), t.tobytes() if with_ids else None) for d, s, t in documents_of(content, wanted)]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_pydict(
                    {"file": pa.array([file] * len(rows), pa.int64())}
                    | {n: pa.array(c, k) for n, c, k in zip(("doc_id", "start", "n_tokens", "ids_crc32", "ids"), cols, (*[pa.int64()] * 4, pa.binary()), strict=True)}
                )

    sums = _files(spark, path).mapInArrow(counts, "file long, n long")
    offsets = sums.select("file", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("file")) - F.col("n")).alias("before"))
    docs = _files(spark, path).mapInArrow(read, "file long, doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return docs.join(offsets, "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
