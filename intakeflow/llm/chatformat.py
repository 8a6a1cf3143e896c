"""Chat formatting: conversations as training windows of a token budget, with loss masks.

Turns are marked by control strings; the same strings inside a text are escaped by a backslash after
their first character, which reading takes off again.  Prefix sums of turn tokens over a conversation
choose the windows: a window is a span of whole turns whose tokens, by the difference of two prefix
sums, fit beside what is repeated in front of them.  Repeated are the conversation's leading system turn and as
many of the last turns as a small budget admits; the loss mask covers each assistant text once, in the
window where it is new.

A conversation is cut into blocks of ``BLOCK`` tokens by its prefix sums before windows are chosen, so a
conversation that holds most of the rows is many groups of bounded size; prefix sums are taken over numbers only, in
chunks.  A turn is never cut: one over the budget stands in a window of its own, beyond the budget.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intakeflow.llm.common import map_texts, written
from intakeflow.llm.packing import word_cache, words_of
from intakeflow.operators.sequence import CHUNK, chunked

BUDGET = 2048            # tokens of a window
HISTORY = 384            # tokens of repeated turns, the system turn apart
SYSTEM = 512             # a longer system turn is not repeated, or windows would hold little else
BLOCK = 64 * BUDGET      # tokens of a block
OUT_BYTES = 4 << 20      # of one record batch of windows

# the template: fixed strings, each one token
START, END = "<s>", "</s>"
_AROUND = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", END)}
_ROLE, _TEXT, _ROLE_END = "[ROLE]", "[TEXT]", "[/ROLE]"
_MARKS = {"system": 2, "user": 2, "assistant": 1}
_ESCAPE = re.compile(r"(?<=<)(\\*)(?=/?s>)|(?<=\[)(\\*)(?=/?(?:SYS|INST|ROLE)\]|TEXT\])")
_UNESCAPE = re.compile(r"(?<=<)\\(?=\\*/?s>)|(?<=\[)\\(?=\\*(?:/?(?:SYS|INST|ROLE)\]|TEXT\]))")

WINDOW = "conv_id long, seq long, fresh int, repeated int, tokens long, text string, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    """The text with a backslash in every control string it holds, also where it holds such backslashes."""
    return _ESCAPE.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text)


def marked(role: str, body: str) -> tuple[str, int]:
    """A turn in the template, of an escaped text, and where the text starts in it."""
    if role in _AROUND:
        before, after = _AROUND[role]
    else:
        before, after = _ROLE + escape(role) + _TEXT, _ROLE_END
    return before + body + after, len(before)


def read_window(text: str) -> list[tuple[str, int, int]]:
    """(role, start, end of its escaped text) of every turn in a formatted window."""
    out, at = [], len(START)
    while at < len(text):
        if text.startswith(_ROLE, at):
            cut = text.index(_TEXT, at)
            role, first, close = unescape(text[at + len(_ROLE):cut]), cut + len(_TEXT), _ROLE_END
        else:
            role = next(r for r, (before, _) in _AROUND.items() if text.startswith(before, at))
            first, close = at + len(_AROUND[role][0]), _AROUND[role][1]
        mark = close.strip()
        end = text.index(mark, first)
        out.append((role, first, end - (len(close) - len(mark))))
        at = end + len(mark)
    return out


def turns(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Written rows (conv_id, turn, role, row, body, tokens): escaped texts and the tokens of the turn in the template.
    A null text or role is empty."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), "text")

    def start():
        known = word_cache(tokenizer)

        def run(texts):
            bodies = [escape(t or "") for t in texts]
            return {"body": bodies, "n": [sum(map(len, v)) // 4 for v in known.look_up(map(words_of, bodies))]}
        return run

    marks = F.lit(3)
    for role, n in _MARKS.items():
        marks = F.when(F.col("role") == role, n).otherwise(marks)
    return written(map_texts(rows, start, {"body": "string", "n": "int"})
                   .withColumn("tokens", (F.col("n") + marks).cast("long")).drop("n")
                   .withColumn("row", F.monotonically_increasing_id()), "chat-turns")


def placed(rows: DataFrame, block: int = BLOCK, history: int = HISTORY, system: int = SYSTEM) -> DataFrame:
    """(row, seg, kind, pos, start): the blocks a turn belongs to; kind 2 where it is new, 1 where it may be
    history, 0 where it is the system turn of a later block.  ``start`` is the prefix sum before the turn."""
    numbers = rows.select("conv_id", "turn", "role", F.xxhash64("body").alias("h"), "row", "tokens")
    order = ["turn", "role", "h", "row"]
    ch = chunked(numbers, ["conv_id"], order)
    inside = Window.partitionBy(CHUNK, "conv_id").orderBy(*order)
    local = ch.withColumn("s", F.sum("tokens").over(inside) - F.col("tokens")).withColumn(
        "p", F.row_number().over(inside) - 1)
    # one row for every conversation and chunk it reaches into
    sums = ch.groupBy("conv_id", CHUNK).agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(F.col("conv_id").alias("c"), F.col(CHUNK).alias("k"),
                        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("cs"),
                        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cp"),
                        F.sum("t").over(Window.partitionBy("conv_id")).alias("total"))
    at = local.join(carry, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col(CHUNK) == F.col("k"))).select(
        "row", "role", "tokens", "total", (F.col("s") + F.col("cs")).alias("start"), (F.col("p") + F.col("cp")).alias("pos"))
    seg = F.floor(F.col("start") / block)
    last = F.floor((F.col("total") - 1) / block)
    new = F.array(F.struct(seg.alias("seg"), F.lit(2).alias("kind")))
    next_ = F.floor((F.col("start") + history) / block)
    context = F.when(next_ > seg, F.array(F.struct(next_.alias("seg"), F.lit(1).alias("kind")))).otherwise(F.array())
    repeats = (F.col("pos") == 0) & (F.col("role") == "system") & (F.col("tokens") <= system) & (last > 0)
    lead = F.when(repeats, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(last, F.lit(1).cast("long"))),
                                       lambda x: F.struct(x.alias("seg"), F.lit(0).alias("kind")))).otherwise(F.array())
    return at.select("row", "pos", "start", F.inline(F.concat(new, context, lead)))


class _Block:
    """Windows of one block, turn by turn."""

    def __init__(self, conv: int | None, budget: int, history: int, system: int):
        self.conv, self.budget, self.history, self.system = conv, budget, history, system
        self.lead: tuple | None = None      # (role, body, tokens) of the system turn
        self.past: list[tuple] = []         # (role, body, tokens) that may be repeated
        self.window: list[tuple] = []       # new turns: (role, body, tokens)
        self.first = self.start = 0

    def add(self, kind: int, role: str, body: str, tokens: int, pos: int, start: int) -> Iterator[dict]:
        turn = (role, body, tokens)
        if kind == 0:
            self.lead = turn
        elif kind == 1:
            self.past.append(turn)
        else:
            if self.window and start + tokens - self.start + self.fixed > self.budget:
                yield self.close()
            if not self.window:
                self.open(pos, start)
            self.window.append(turn)
            if pos == 0 and role == "system" and tokens <= self.system:
                self.lead = turn

    def open(self, pos: int, start: int) -> None:
        """A new window: what is repeated is known, its new turns are still to come."""
        self.first, self.start = pos, start
        back, room = len(self.past), self.history
        while back and self.past[back - 1][2] <= room and self.past[back - 1] is not self.lead:
            back -= 1
            room -= self.past[back][2]
        self.past = self.past[back:]
        self.repeated = ([self.lead] if self.lead else []) + self.past
        self.fixed = 1 + sum(t[2] for t in self.repeated)

    def close(self) -> dict:
        parts, loss, at = [START], [], len(START)
        for k, (role, body, _) in enumerate([*self.repeated, *self.window]):
            text, first = marked(role, body)
            if k >= len(self.repeated) and role == "assistant":
                loss.append({"start": at + first, "end": at + first + len(body)})
            parts.append(text)
            at += len(text)
        out = {"conv_id": self.conv, "seq": self.first, "fresh": len(self.window), "repeated": len(self.repeated),
               "tokens": self.fixed + sum(t[2] for t in self.window), "text": "".join(parts), "loss": loss}
        self.past += self.window
        self.window = []
        return out


def windows(conversations: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY,
            system: int = SYSTEM, block: int = BLOCK) -> DataFrame:
    """One row per window of ``conversations (conv_id, turn, role, text)``; other columns are left alone.

    conv_id; seq, the place of the window's first new turn, which orders a conversation's windows; fresh and
    repeated, the numbers of its new turns and of those repeated in front of them; tokens; text; loss, the
    spans of text (in code points) under the loss mask.  Rows without a conv_id are one conversation.  Turns with
    the same number come in the order of their roles, a null turn first; repeated rows are turns of their own.
    ``history`` must be below ``block``, ``system`` and ``history`` together below ``budget``.
    """
    rows = turns(conversations, tokenizer)
    spread = rows.join(placed(rows, block, history, system), "row").select(
        "conv_id", "seg", "kind", "pos", "start", "role", "tokens", "body")
    sorted_ = spread.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "kind", "pos")

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(WINDOW))

    def run(batches):
        now, key, out, size = None, None, [], 0
        for b in batches:
            for conv, seg, kind, pos, start, role, tokens, body in zip(*(c.to_pylist() for c in b.columns)):
                done = []
                if (conv, seg) != key:
                    if now is not None and now.window:
                        done.append(now.close())
                    now, key = _Block(conv, budget, history, system), (conv, seg)
                done += now.add(kind, role, body, tokens, pos, start)
                for w in done:
                    out.append(w)
                    size += len(w["text"])
                if size > OUT_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if now is not None and now.window:
            out.append(now.close())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return sorted_.mapInArrow(run, WINDOW)


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the windows of every conversation: n_turns, turns_sha256 over all turns (role, line
    end, text, line end), loss_chars and loss_sha256 over all text under the loss mask, formatted_chars.

    Windows pass in order and are forgotten; a hash over a whole conversation can only be taken in order."""
    sorted_ = formatted.select("conv_id", "seq", "repeated", "text", "loss").repartition("conv_id").sortWithinPartitions(
        "conv_id", "seq")

    def run(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state, out = None, []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        def ended():
            conv, n, turn_hash, chars, loss_hash, size = state
            return conv, n, turn_hash.hexdigest(), chars, loss_hash.hexdigest(), size

        for b in batches:
            for conv, _, repeated, text, loss in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(ended())
                        if len(out) >= 10_000:
                            yield batch()
                            out = []
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, s, e in read_window(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{unescape(text[s:e])}\n".encode())
                for span in loss:
                    t = unescape(text[span["start"]:span["end"]])
                    state[3] += len(t)
                    state[4].update(t.encode())
                state[5] += len(text)
        if state is not None:
            out.append(ended())
        if out:
            yield batch()

    return sorted_.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                   "loss_sha256 string, formatted_chars long")
