"""Chat formatting with a grammar round trip.

A turn is rendered as ``<s>role[INST]text[/INST]</s>``.  The rendered text is parsed
again by a deterministic parser; where role or text do not come back as they were,
the conflicting content is escaped and the turn rendered anew, until they do.

Escape: a control string, also one that holds backslashes after its first character,
gets one more backslash there.  The parser takes one away.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import shared

#: The control strings.
OPEN, BODY, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = re.compile(r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])")
LEARNED = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[1] or m[4]}\\{m[2] or m[5] or ''}{m[3] or m[6]}", text)


def unescape(text: str) -> str:
    def less(m: re.Match) -> str:
        slashes = m[2] if m[1] else m[5]
        return f"{m[1] or m[4]}{slashes[1:]}{m[3] or m[6]}"

    return CONTROL.sub(less, text)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end of the escaped text.
    Raises ValueError where the grammar does not hold."""
    turns, expect, at, role, start = [], OPEN, 0, "", 0
    after = {OPEN: BODY, BODY: CLOSE, CLOSE: END, END: OPEN}
    for m in CONTROL.finditer(text):
        if m[2] or m[5]:
            continue
        if m[0] != expect:
            raise ValueError(f"{m[0]} at {m.start()} where {expect} must stand")
        between = text[at : m.start()]
        if expect == BODY:
            role, start = unescape(between), m.end()
        elif expect == CLOSE:
            turns.append((role, unescape(between), start, m.start()))
        elif between:
            raise ValueError(f"text outside a turn at {at}")
        expect, at = after[expect], m.end()
    if expect != OPEN or at != len(text):
        raise ValueError("the text ends inside a turn")
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and where its text lies in it."""
    who, what = role, text
    for _ in range(3):
        out = f"{OPEN}{who}{BODY}{what}{CLOSE}{END}"
        try:
            found = parse(out)
        except ValueError:
            found = []
        if len(found) == 1 and found[0][:2] == (role, text):
            return out, found[0][2], found[0][3]
        who, what = escape(role), escape(text)
    raise ValueError("a turn does not come back from its rendering")


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: str = LEARNED) -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end): one rendered segment per row; a
    conversation's text is its segments in turn order with nothing between.  The loss
    mask is the half-open code point span of a ``learned`` role's escaped text, null for
    other roles.  No shuffle: a conversation of any length costs a task nothing extra.

    Null role and text are empty.  An empty table gives an empty result; other columns
    are not looked at.
    """
    picked = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            made = []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                out, i, j = render(role, text)
                made.append((out, i, j) if role == learned else (out, None, None))
            cols = zip(*made) if made else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64())))], ["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    return picked.mapInArrow(run, "conv_id long, turn long, formatted string, loss_start long, loss_end long")


def digests(segments: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed
    back from the segments, which stream through in order: memory holds one batch.
    Rows of one turn number follow each other in the order of their segments; a null
    turn comes first; null conv_ids form one conversation."""
    keys = ["conv_id", "turn", "formatted"]
    kinds = (("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()))

    def run(batches):
        now, started = None, False
        state = None

        def row():
            n, turns, chars, loss, size = state
            return (now, n, turns.hexdigest(), chars, loss.hexdigest(), size)

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [k for k, _ in kinds])

        for batch in batches:
            done = []
            for conv, _, text, i, j in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or conv != now:
                    if started:
                        done.append(row())
                    now, started, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in parse(text):
                    state[0] += 1
                    state[1].update(shared.utf8(f"{role}\n{said}\n"))
                if i is not None:
                    under = unescape(text[i:j])
                    state[2] += len(under)
                    state[3].update(shared.utf8(under))
                state[4] += len(text)
            if done:
                yield out(done)
        if started:
            yield out([row()])

    sorted_ = segments.select(*keys, "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions(*keys)
    return sorted_.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
