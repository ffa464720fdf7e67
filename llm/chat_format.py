"""Chat formatting: a finite-state machine walks over the turns of a conversation and emits text segments, each with a
flag that says whether a model is to be trained on it. A template declares markers, roles and transitions.

A formatted conversation is the texts of its segments in order. It is a table, not one string: a conversation may be
longer than a cell. ``read_back`` restores turns and loss spans from the segments' texts and flags alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.conversations import Rows, in_order, rows_of, turns_of


@dataclass(frozen=True)
class Template:
    """How conversations are written and which turns may follow which.

    ``pattern`` lists the segments of a turn as (text, trained): ``{role}`` and ``{text}`` stand for the escaped role
    and text, and ``trained`` only counts for roles in ``trained_roles``. The first segment must start with the opening
    marker and the last end with the closing one; ``{role}`` ends at ``role_end``. ``controls`` are strings that mean
    something to a reader of the output: where a text holds one, ``escape`` is put before it, as before ``escape`` itself.
    ``transitions`` maps (state, role) to the next state; a role without a transition is an illegal turn, after which
    the machine goes on from the state ``resume`` names for that role. ``final`` are the states a conversation may end in.
    """

    opening: str = "<turn>"
    role_end: str = "\n"
    closing: str = "</turn>\n"
    pattern: tuple[tuple[str, bool], ...] = (("<turn>{role}\n", False), ("{text}", True), ("</turn>\n", False))
    escape: str = "\\"
    controls: tuple[str, ...] = ("<turn>", "</turn>", "### System:", "### User:", "### Assistant:")
    trained_roles: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    resume: dict[str, str] = field(default_factory=lambda: {"system": "told", "user": "asked", "assistant": "answered"})
    final: frozenset[str] = frozenset({"start", "answered"})

    def escaper(self, *more: str):
        """A function that puts the escape mark before itself and before each control string."""
        marks = sorted({self.escape, *self.controls, *more}, key=len, reverse=True)
        found = re.compile("|".join(map(re.escape, marks)))
        return lambda text: found.sub(lambda m: self.escape + m[0], text)

    def unescape(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + r"(.)", r"\1", text, flags=re.DOTALL)


SEGMENTS = pa.schema(
    [("conv_id", pa.int64()), ("turn_no", pa.int64()), ("segment_no", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()), ("state", pa.string()), ("legal", pa.bool_())]
)
SEGMENT_COLUMNS = "conv_id long, turn_no long, segment_no long, text string, loss boolean, state string, legal boolean"
DIGESTS = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("illegal_turns", pa.int64()), ("complete", pa.bool_())]
)
DIGEST_COLUMNS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, illegal_turns long, complete boolean"
)
_START = object()


def segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per segment of ``conversations(conv_id, turn, role, text)``: ``conv_id, turn_no, segment_no, text, loss,
    state, legal``, in order within a partition that holds the whole conversation.

    Turns go by ``turn`` (nulls first), those of one turn by role and text; repeated rows are turns of their own. A null
    role or text is empty; a null ``conv_id`` is a conversation. Illegal turns are formatted too and marked
    (``legal``). Other columns are ignored; an empty table gives no rows.
    """
    template = template or Template()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_text, of_role = template.escaper(), template.escaper(template.role_end)
        own, state, number, out = _START, template.start, 0, Rows(SEGMENTS)
        for conv_id, _, role, text in rows_of(batches):
            if conv_id != own or own is _START:
                own, state, number = conv_id, template.start, 0
            following = template.transitions.get((state, role))
            legal, state = following is not None, following or template.resume.get(role, template.start)
            trained = role in template.trained_roles
            values = {"{role}": of_role(role), "{text}": of_text(text)}
            for at, (form, counts) in enumerate(template.pattern):
                body = re.sub(r"\{(?:role|text)\}", lambda m: values[m[0]], form)
                out.put((own, number, at, body, counts and trained, state, legal), len(body))
            number += 1
            if out.full:
                yield out.batch()
        yield out.batch()

    return in_order(turns_of(conversations)).mapInArrow(walk, SEGMENT_COLUMNS)


class Reader:
    """Reads one formatted conversation, segment by segment: its turns, and what stands under the loss mask."""

    def __init__(self, template: Template):
        self.template = template
        mark, close = re.escape(template.escape), re.escape(template.closing)
        self.token = re.compile(f"{mark}(.)|({close})", re.DOTALL)
        self.head = re.compile(f"(?:{mark}.|[^{mark}])*?(?={re.escape(template.role_end)})", re.DOTALL)
        self.turns, self.turn_sha, self.chars = 0, hashlib.sha256(), 0
        self.loss_sha, self.loss_chars = hashlib.sha256(), 0
        self.pending: list[str] = []

    def feed(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        if loss:
            plain = self.template.unescape(text)
            self.loss_chars += len(plain)
            self.loss_sha.update(plain.encode())
        self.pending.append(text)
        # A turn is over where the closing marker stands unescaped; markers are whole within a segment.
        end = next((m.end() for m in self.token.finditer(text) if m[2] is not None), None)
        if end is not None:
            self.close("".join(self.pending))
            self.pending = []

    def close(self, turn: str) -> None:
        inner = turn[len(self.template.opening) : -len(self.template.closing)]
        role = self.head.match(inner)[0]
        body = inner[len(role) + len(self.template.role_end) :]
        self.turns += 1
        self.turn_sha.update(f"{self.template.unescape(role)}\n{self.template.unescape(body)}\n".encode())


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation of ``segments``, from its texts and flags alone: ``conv_id, n_turns``, the digest of
    role, line feed, text, line feed for each turn, the length and digest of all text under the loss mask, the length of
    the formatted text, the number of illegal turns, and whether it ends in a final state."""
    template = template or Template()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, reader, illegal, state, out = _START, None, 0, template.start, Rows(DIGESTS)

        def done() -> None:
            r = reader
            out.put((own, r.turns, r.turn_sha.hexdigest(), r.loss_chars, r.loss_sha.hexdigest(), r.chars, illegal, state in template.final))

        for conv_id, _, segment_no, text, loss, now, legal in rows_of(batches):
            if conv_id != own or own is _START:
                if reader:
                    done()
                own, reader, illegal = conv_id, Reader(template), 0
            reader.feed(text, loss)
            illegal += segment_no == 0 and not legal
            state = now
            if out.full:
                yield out.batch()
        if reader:
            done()
        yield out.batch()

    return formatted.mapInArrow(read, DIGEST_COLUMNS)


def with_control_case(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, numbered -7, whose two turns hold control strings and the escape mark."""
    text = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    case = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return turns_of(conversations).unionByName(turns_of(case))


def digests(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    return read_back(segments(conversations, template), template)
