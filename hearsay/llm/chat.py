"""Chat formatting checked by a grammar round trip.

The rendered form of a turn is ``<|turn|>role<|says|>text<|done|>``; a conversation is its
turns one after the other. Its grammar is regular, so a deterministic parser reads it back:

    conversation = turn*
    turn         = "<|turn|>" plain "<|says|>" plain "<|done|>"
    plain        = any characters in which no mark stands

A text is first rendered as it is. The parser reads the result; if the turns it recovers are
not the source, the conflicting content is escaped one level further and the turn is rendered
again, until both are identical. Level 0 escapes nothing, level 1 the template's own marks,
level 2 every control string of the known chat formats as well, where a mark stands for a
string that a tokenizer might take for a special token. The level is part of the role field,
so the reader undoes just what was done.

An escaped control string has the escape character after its first character. Escape characters
that the text itself has there are doubled, hence escaping is reversible.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.frames import slices

TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
MARKS = (TURN, SAYS, DONE)
#: Strings with a meaning of their own in public chat formats.
CONTROL_STRINGS = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|begin_of_text|>",
    "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|user|>",
    "<|assistant|>", "<|system|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]",
    "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>",
)
ESCAPE = "\\"
#: The role whose texts are learned.
LEARNED = "assistant"


def _guards(strings: tuple[str, ...]) -> tuple[re.Pattern, re.Pattern]:
    """What to escape in a text, and what to undo: a control string with any number of escape
    characters after its first character."""
    body = "|".join(
        f"{re.escape(s[0])}(?:{re.escape(ESCAPE)})*{re.escape(s[1:])}"
        for s in sorted(strings, key=len, reverse=True)
    )
    return re.compile(f"(?={body})."), re.compile(f"(?={body}).{re.escape(ESCAPE)}")


LEVELS = (None, _guards(MARKS), _guards(MARKS + CONTROL_STRINGS))
#: What a text may hold at which level: marks break the grammar, control strings the tokenizer.
CONTROL = re.compile("|".join(map(re.escape, CONTROL_STRINGS)))


def escaped(text: str, level: int) -> str:
    return LEVELS[level][0].sub(lambda m: m.group() + ESCAPE, text) if level else text


def unescaped(text: str, level: int) -> str:
    return LEVELS[level][1].sub(lambda m: m.group()[0], text) if level else text


def rendered(role: str, text: str, levels: tuple[int, int]) -> str:
    head = f"{levels[0]}{levels[1]}{escaped(role, levels[0])}"
    return f"{TURN}{head}{SAYS}{escaped(text, levels[1])}{DONE}"


_MARK = re.compile("|".join(map(re.escape, MARKS)))


def parse(output: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered conversation; None where it breaks the grammar."""
    turns: list[tuple[str, str]] = []
    fields: list[str] = []
    at = 0
    for mark in _MARK.finditer(output):
        if mark.group() != MARKS[len(fields)]:
            return None
        between = output[at:mark.start()]
        at = mark.end()
        if not fields and between:
            return None
        fields.append(between)
        if len(fields) == 3:
            head = fields[1]
            if not re.match("[012][012]", head):
                return None
            turns.append((unescaped(head[2:], int(head[0])), unescaped(fields[2], int(head[1]))))
            fields = []
    return None if fields or at != len(output) else turns


def render_turn(role: str, text: str) -> str:
    """The rendered turn, escaped as little as the round trip allows.

    Neighbours cannot change how it is read: it starts and ends with a mark, and no mark
    overlaps another.
    """
    first = [2 if CONTROL.search(x) else 0 for x in (role, text)]
    for levels in sorted({(r, t) for r in (first[0], 1, 2) for t in (first[1], 1, 2)
                          if r >= first[0] and t >= first[1]}, key=sum):
        output = rendered(role, text, levels)
        if parse(output) == [(role, text)]:
            return output
    raise ValueError("a turn could not be rendered reversibly")


def format_turns(turns: DataFrame) -> DataFrame:
    """Every row with ``formatted``: its turn as rendered, in columns conv_id, turn, formatted.

    Null roles and texts count as empty. Each row is rendered and read back by itself, so a
    conversation may have any number of turns.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in slices(batch):
                found = [
                    render_turn(role or "", text or "")
                    for role, text in zip(part.column("role").to_pylist(),
                                          part.column("text").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("turn"), pa.array(found, pa.string())],
                    ["conv_id", "turn", "formatted"],
                )

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(
        batches, "conv_id bigint, turn bigint, formatted string"
    )


def loss_spans(output: str) -> list[tuple[int, int]]:
    """Code point spans of a rendered conversation that count for the loss: the assistant's
    texts, without marks."""
    spans, fields, starts = [], [], []
    at = 0
    for mark in _MARK.finditer(output):
        fields.append(output[at:mark.start()])
        starts.append((at, mark.start()))
        at = mark.end()
        if mark.group() == DONE:
            head = fields[-2]
            if unescaped(head[2:], int(head[0])) == LEARNED:
                spans.append(starts[-1])
    return spans


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id and ``formatted``: all turns by turn number, as one string.

    Equal turn numbers are ordered by their rendered form; repeated rows stay. Null turn
    numbers come first and a null conv_id is a conversation of its own. Meant for
    conversations that fit in a row; ``digests`` reads longer ones turn by turn.
    """
    return (
        format_turns(turns)
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "formatted"))).alias("rows"))
        .select("conv_id", F.concat_ws("", F.col("rows.formatted")).alias("formatted"))
    )


def digests(turns: DataFrame) -> DataFrame:
    """What the formatted output says when it is read back, per conversation.

    Rows arrive sorted and are hashed as they come: no task holds a whole conversation. The
    loss text is cut out of the output by ``loss_spans`` and then unescaped.
    """
    ordered = (
        format_turns(turns)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "formatted")
    )

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in rows:
            done = []
            for conv, formatted in zip(batch.column("conv_id").to_pylist(),
                                       batch.column("formatted").to_pylist()):
                if state is None or state.conv != conv:
                    if state is not None:
                        done.append(state.row())
                    state = _Reading(conv)
                state.add(formatted)
            yield _rows(done)
        if state is not None:
            yield _rows([state.row()])

    return ordered.mapInArrow(batches, DIGEST_SCHEMA)


DIGEST_SCHEMA = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
    "loss_sha256 string, formatted_chars bigint"
)


class _Reading:
    """Running digests of a conversation that is read turn by turn."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str) -> None:
        parsed = parse(formatted)
        self.turns += len(parsed)
        self.chars += len(formatted)
        for role, text in parsed:
            self.all.update(f"{role}\n{text}\n".encode())
        for start, stop in loss_spans(formatted):
            # The head's second digit is the level of the text.
            head = formatted.rindex(TURN, 0, start) + len(TURN)
            text = unescaped(formatted[start:stop], int(formatted[head + 1]))
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars,
                self.loss.hexdigest(), self.chars)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names)
