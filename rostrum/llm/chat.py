"""Chat formatting with a grammar that reads its own output back.

    conversation = "<s>" turn*
    turn         = "[INST] " text " [/INST]"          user
                 | "[SYS] " text " [/SYS]"            system
                 | "[OUT] " text "</s>"               assistant
                 | "[ROLE " text "] " text " [/ROLE]" any other role
    text         = (any character | "\\\\" escaped)*, without an unescaped control string

A text is written as it is if the parser gives it back; else its control strings and
backslashes are escaped, and if that does not do, every character that could begin one.
So most texts stay untouched, and every turn can be read back alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BEGIN = "<s>"
# What opens and closes a turn, by role.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("[OUT] ", "</s>")}
ROLE_OPEN, ROLE_NAMED, ROLE_CLOSE = "[ROLE ", "] ", " [/ROLE]"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[ROLE", "[/ROLE]")
LOSS_ROLE = "assistant"

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_SPECIAL = re.compile(r"\\|" + _CONTROL.pattern)
_ANY = re.compile(r"[\\<\[\] ]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_STOP = re.compile(r"\\.|" + _CONTROL.pattern, re.DOTALL)
_NAME_STOP = re.compile(r"\\.|\]|" + _CONTROL.pattern, re.DOTALL)


class Malformed(ValueError):
    pass


def _unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _escapes(text: str) -> Iterator[str]:
    yield text
    yield _SPECIAL.sub(lambda m: "\\" + m[0], text)
    yield _ANY.sub(lambda m: "\\" + m[0], text)


def parse_turn(rendered: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """`(role, text, start, stop, end)` of the turn at `at`; start and stop bound the text
    as rendered. One pass, no backtracking."""
    role = next((r for r, (o, _) in MARKS.items() if rendered.startswith(o, at)), None)
    if role is not None:
        start, close = at + len(MARKS[role][0]), MARKS[role][1]
    elif rendered.startswith(ROLE_OPEN, at):
        name = at + len(ROLE_OPEN)
        stop = next((m for m in _NAME_STOP.finditer(rendered, name) if m[0][0] != "\\"), None)
        if stop is None or not rendered.startswith(ROLE_NAMED, stop.start()):
            raise Malformed(rendered[at:at + 80])
        role = _unescape(rendered[name:stop.start()])
        if role in MARKS:
            raise Malformed(rendered[at:at + 80])
        start, close = stop.start() + len(ROLE_NAMED), ROLE_CLOSE
    else:
        raise Malformed(rendered[at:at + 80])
    stop = next((m for m in _STOP.finditer(rendered, start) if m[0][0] != "\\"), None)
    if stop is None:
        raise Malformed(rendered[at:at + 80])
    end = stop.start() - (close[0] == " ")
    if end < start or not rendered.startswith(close, end):
        raise Malformed(rendered[at:at + 80])
    return role, _unescape(rendered[start:end]), start, end, end + len(close)


def render_turn(role: str, text: str) -> str:
    """The turn with the least escaping that the parser gives back unchanged."""
    for name in _escapes(role):
        for body in _escapes(text):
            if role in MARKS:
                opening, close = MARKS[role]
            else:
                opening, close = ROLE_OPEN + name + ROLE_NAMED, ROLE_CLOSE
            out = opening + body + close
            try:
                got = parse_turn(out)
            except Malformed:
                continue
            if got[:2] == (role, text) and got[4] == len(out):
                return out
    raise Malformed(f"no escaping brings back {role!r}: {text[:80]!r}")


def parse(rendered: str) -> list[tuple[str, str]]:
    """Turns of a whole conversation."""
    if not rendered.startswith(BEGIN):
        raise Malformed(rendered[:80])
    at, turns = len(BEGIN), []
    while at < len(rendered):
        role, text, _, _, at = parse_turn(rendered, at)
        turns.append((role, text))
    return turns


def render(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """`(conv, turn, role, text, rendered, loss_start, loss_stop)`: every turn as it stands in
    its conversation, and the span under the loss mask within it (null: none).

    Turns are independent, so this is one pass without a shuffle. A null role or text
    counts as empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, starts, stops = [], [], []
            for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                whole = render_turn(r, t)
                got, _, start, stop, _ = parse_turn(whole)
                out.append(whole)
                starts.append(start if got == LOSS_ROLE else None)
                stops.append(stop if got == LOSS_ROLE else None)
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array(out, pa.string()), pa.array(starts, pa.int32()),
                pa.array(stops, pa.int32()),
            ], ["conv", "turn", "role", "text", "rendered", "loss_start", "loss_stop"])

    rows = df.select(
        F.col(f"`{conversation}`").cast("bigint").alias("conv"),
        F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, "conv bigint, turn bigint, role string, text string, "
                                "rendered string, loss_start int, loss_stop int")


class _Reader:
    """What a conversation's turns add up to, read from its output piece by piece."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, len(BEGIN)
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, rendered: str, start: int | None, stop: int | None) -> None:
        role, text, _, _, end = parse_turn(rendered)
        if end != len(rendered):
            raise Malformed(rendered[:80])
        self.turns += 1
        self.chars += len(rendered)
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if start is not None:
            under = _unescape(rendered[start:stop])
            self.loss_chars += len(under)
            self.loss.update(under.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


DIGESTS = ("conv bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
           "formatted_chars bigint")


def read_back(rendered: DataFrame) -> DataFrame:
    """One row of digests per conversation, from the output of `render` alone.

    A conversation is the concatenation of its turns by (turn, role, text), behind one
    opening mark; rows without a conversation id are one conversation. The digest of a
    conversation depends on what came before, so its turns pass through one task - as a
    stream that holds one batch, not as a group.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Reader | None = None
        for batch in batches:
            done = []
            for conv, *turn in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Reader(conv)
                now.add(*turn)
            if done:
                yield _digests(done)
        if now is not None:
            yield _digests([now.row()])

    return rendered.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select(
        "conv", "rendered", "loss_start", "loss_stop"
    ).mapInArrow(run, DIGESTS)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [part.split()[0] for part in DIGESTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def conversations(rendered: DataFrame) -> DataFrame:
    """`(conv, formatted)`: whole texts, for conversations that fit one row."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "rendered")))
    return rendered.groupBy("conv").agg(
        F.concat(F.lit(BEGIN), F.array_join(F.transform(turns, lambda t: t["rendered"]), "")).alias("formatted")
    )
