"""Chat formatting: a finite-state machine over roles, and text segments with loss flags.

A template is data: which roles may follow which, and the pieces around a turn with the roles
that carry loss. Control strings inside roles and texts are escaped (``\\`` before the second
character of ``<|`` and before any ``\\``), so the output can be read back exactly.

Reading uses the segments' texts and loss flags alone: turns are found in the joined text, and
the text under loss is what the flags mark, unescaped; it is held against the roles, and
``mask_agrees`` says whether both name the same text in every turn.

Rows of a conversation are streamed in order of turn (then role and text), one turn in memory
at a time, so a conversation of any length needs no more than its longest turn. Defined cases:
a null role or text is empty; a turn order that the machine refuses is formatted all the same,
with ``valid`` false and the first refused turn; a null conversation id is a conversation of its
own; repeated rows are turns of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches


@dataclass(frozen=True)
class Template:
    """Marks around a turn, the roles under loss, and the state machine of roles."""

    turn_start: str = "<|im_start|>"
    role_end: str = "\n"
    turn_end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: tuple[str, ...] = ("system", "user")
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant", "tool")}
    )
    last: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if not (self.turn_start.startswith("<|") and self.turn_end.startswith("<|") and self.role_end == "\n"):
            raise ValueError("turn marks must start with <| and roles end with a line end, as these are what texts and roles are escaped for")


CHAT = Template()
SEGMENT = "conv_id long, segment long, turn long, kind string, text string, loss boolean"
_SEGMENT = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("turn", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("loss", pa.bool_())])
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, refused_turn long, mask_agrees boolean"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def turn_segments(role: str, text: str, template: Template = CHAT) -> list[tuple[str, str, bool]]:
    """(kind, text, under loss) of one turn."""
    loss = role in template.loss_roles
    return [("header", template.turn_start + escape_role(role) + template.role_end, False), ("text", escape(text), loss), ("end", template.turn_end, False)]


def format_chats(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """The segments of every conversation; their texts joined in order of ``segment`` are the formatted conversation."""
    small_batches(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no conversation yet
        segment = turn = 0
        for b in batches:
            rows = []
            for conv, role, text in zip(*(b[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != now:
                    now, segment, turn = conv, 0, 0
                for kind, piece, loss in turn_segments(role or "", text or "", template):
                    rows.append((conv, segment, turn, kind, piece, loss))
                    segment += 1
                turn += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SEGMENT, strict=True)], schema=_SEGMENT)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENT)


class Reader:
    """Reads one conversation back from its segments' texts and loss flags, turn by turn, and checks its turn order."""

    def __init__(self, conv_id: int | None, template: Template) -> None:
        self.conv_id, self.template = conv_id, template
        self.pieces: list[tuple[str, bool]] = []
        self.tail = ""  # enough of the text so far to see a turn end that starts in it
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.allowed, self.role, self.refused, self.mask_agrees = template.start, None, None, True
        header = rf"{re.escape(template.turn_start)}((?:\\.|[^\\\n])*){re.escape(template.role_end)}"
        self.header = re.compile(header, re.DOTALL)

    def add(self, piece: str, loss: bool) -> None:
        self.chars += len(piece)
        end = self.template.turn_end
        while piece:
            at = (self.tail + piece).find(end)
            if at < 0:
                self.pieces.append((piece, loss))
                self.tail = (self.tail + piece)[1 - len(end) :]
                return
            upto = at + len(end) - len(self.tail)
            self.pieces.append((piece[:upto], loss))
            piece, self.tail = piece[upto:], ""
            self._turn()

    def _turn(self) -> None:
        t, whole = self.template, "".join(p for p, _ in self.pieces)
        head = self.header.match(whole)
        if not head:
            raise ValueError(f"conversation {self.conv_id}: a turn can't be read back")
        role, text = unescape(head[1]), unescape(whole[head.end() : -len(t.turn_end)])
        marked = unescape("".join(p for p, loss in self.pieces if loss))
        self.pieces = []
        if self.refused is None and role not in self.allowed:
            self.refused = self.n_turns
        self.allowed, self.role = t.follows.get(role, ()), role
        self.turns.update(f"{role}\n{text}\n".encode())
        self.loss.update(marked.encode())
        self.loss_chars += len(marked)
        self.mask_agrees &= marked == (text if role in t.loss_roles else "")
        self.n_turns += 1

    def result(self) -> tuple:
        if self.pieces:
            raise ValueError(f"conversation {self.conv_id}: its last turn has no end")
        valid = self.refused is None and self.role in self.template.last
        return (self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, valid, self.refused, self.mask_agrees)


def read_back(segments: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row a conversation, read back from written segments; only (conv_id, segment, text, loss) are used."""
    small_batches(segments.sparkSession)
    names = [c.split()[0] for c in DIGEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: Reader | None = None
        for b in batches:
            done = []
            for conv, segment, text, loss in zip(*(b[c].to_pylist() for c in ("conv_id", "segment", "text", "loss")), strict=True):
                if segment == 0:
                    done += [reader.result()] if reader else []
                    reader = Reader(conv, template)
                reader.add(text, loss)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        if reader:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(reader.result(), kinds, strict=True)], names)

    rows = segments.select("conv_id", "segment", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return rows.mapInArrow(run, DIGEST)
