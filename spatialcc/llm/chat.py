"""Chat formatting in budgeted windows.

Turns are laid out in a template whose control strings can't appear in escaped texts. Prefix sums of turn tokens choose
turn-aligned windows within a budget; each window keeps the system turn, repeats a limited history, and puts every
assistant turn under the loss mask exactly once. Rows are streamed in order, so memory holds one window, not one
conversation; long conversations are dealt out in chunks of rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spatialcc.llm.common import land, sized, work_dir
from spatialcc.llm.token_counts import counter

#: Tokens of a window, and of the history that it repeats. A turn that is larger than the budget has a window to itself.
BUDGET, HISTORY = 1024, 256
#: Rows of a chunk: windows don't cross its edges, so one conversation can be formatted by many tasks.
CHUNK = 4096

# The template.
START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """The text without '<|': a backslash goes before each backslash and into each '<|'."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    """As escape(), and a line feed becomes a backslash and an n."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def layout(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back from a formatted window."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


class _Windows:
    """Windows of one chunk of a conversation, from turns in order."""

    def __init__(self, key: tuple, budget: int, history: int):
        self.key, self.budget, self.history = key, budget, history
        self.system: tuple | None = None
        self.past: list[tuple] = []  # turns that may be repeated, latest last
        self.now: list[tuple] = []  # turns that are new in this window
        self.size = 0  # tokens of system turn, history and new turns
        self.before: list[tuple] = []  # the history of this window
        self.number = 0

    def context(self, turn: tuple, opening: bool) -> None:
        """A turn of an earlier chunk: the system turn that opens the conversation, or history."""
        if opening:
            self.system = turn
        elif turn != self.system:  # the system turn stands before the history, not in it
            self.past.append(turn)

    def _fixed(self) -> int:
        return self.system[2] if self.system else 0

    def _open(self, turn: tuple) -> None:
        room = min(self.history, self.budget - self._fixed() - turn[2])
        self.before, used = [], 0
        for old in reversed(self.past):
            if used + old[2] > room:
                break
            used += old[2]
            self.before.insert(0, old)
        self.size = self._fixed() + used

    def add(self, turn: tuple) -> Iterator[dict]:
        if self.now and self.size + turn[2] > self.budget:
            yield self._close()
        if not self.now:
            self._open(turn)
        self.now.append(turn)
        self.size += turn[2]

    def _close(self) -> dict:
        lead = [] if self.system is None or self.now[0] is self.system else [self.system]
        parts, spans, at = [], [], 0
        repeated = lead + self.before
        for k, (role, text, _) in enumerate(repeated + self.now):
            laid, a, b = layout(role, text)
            if k >= len(repeated) and role == "assistant":
                spans.append([at + a, at + b])
            parts.append(laid)
            at += len(laid)
        row = {"conv_id": self.key[0], "chunk": self.key[1], "window": self.number, "formatted": "".join(parts), "n_tokens": self.size, "n_repeated": len(repeated), "loss_from": [s[0] for s in spans], "loss_to": [s[1] for s in spans]}
        kept, total = [], 0
        for turn in reversed([t for t in self.past + self.now if t is not self.system]):  # no more than can be repeated
            if total > self.history:
                break
            total += turn[2]
            kept.insert(0, turn)
        self.past, self.now, self.before, self.size = kept, [], [], 0
        self.number += 1
        return row

    def finish(self) -> Iterator[dict]:
        if self.now:
            yield self._close()


_SCHEMA = "conv_id {kind}, chunk bigint, window int, formatted string, n_tokens bigint, n_repeated int, loss_from array<bigint>, loss_to array<bigint>"


def format_chats(turns: DataFrame, path: str | None = None, budget: int = BUDGET, history: int = HISTORY, chunk: int = CHUNK) -> DataFrame:
    """Windows of all conversations: conv_id, chunk, window, formatted, n_tokens, n_repeated, loss_from, loss_to.

    turns: conv_id, turn, role, text. path: the tokenizer whose tokens the budget counts; without one, four
    characters count as a token. A conversation's rows are ordered by turn, role and text, nulls first; rows that
    repeat a turn are turns of their own; null roles and texts are empty; rows without conv_id form one conversation.
    The first n_repeated turns of a window repeat earlier ones: the system turn (a first turn of that role) and as
    many of the latest turns as the history's tokens allow. loss_from and loss_to are code points of the formatted
    window: the escaped texts of its new assistant turns. Texts are never cut: a turn beyond the budget has a window
    of its own. Conversations of more than `chunk` rows are cut after about every `chunk` rows, wherever their turn numbers
    lie; rows of one turn number stay together. Windows don't cross the cuts, but repeat history across them like
    anywhere else. Extra columns are ignored; an empty table gives no windows.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.lit(0).cast("bigint").alias("chunk"), F.lit(1).alias("new"),
    )
    long = land(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk).select(F.col("conv_id").alias("_long")), work_dir(turns.sparkSession, "long"))
    every = rows if long.isEmpty() else _in_chunks(rows, long, history, chunk)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: Callable[[list[str]], list[int]] = counter(path) if path else lambda texts: [-(-len(x) // 4) for x in texts]
        now: _Windows | None = None
        for frame in frames:
            out = []
            for lo in range(0, len(frame), 256):
                part = frame.iloc[lo : lo + 256]
                sizes = count([layout(r, t)[0] for r, t in zip(part["role"], part["text"], strict=True)])
                for conv, piece, new, role, text, size in zip(part["conv_id"], part["chunk"], part["new"], part["role"], part["text"], sizes, strict=True):
                    key = (None if pd.isna(conv) else conv, int(piece))
                    if now is None or now.key != key:
                        if now is not None:
                            out += now.finish()
                        now = _Windows(key, budget, history)
                    turn = (role, text, size)
                    if new < 1:
                        now.context(turn, new < 0)
                        continue
                    out += now.add(turn)
                    if role == "system" and now.system is None and now.number == 0 and len(now.now) == 1 and not now.past:
                        now.system = turn
            if out:
                yield pd.DataFrame(out)
        if now is not None and (out := list(now.finish())):
            yield pd.DataFrame(out)

    dealt = every.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "new", "turn", "role", "text")
    return dealt.mapInPandas(run, _SCHEMA.format(kind=kind))


def _in_chunks(rows: DataFrame, long: DataFrame, history: int, chunk: int) -> DataFrame:
    """The rows with those of long conversations in chunks, and what later chunks may repeat of earlier ones.

    A turn's place is the number of rows before it in its conversation: counts of turns are dealt by range, summed in
    each range and over the ranges, so that no task needs a conversation's rows together. A turn costs a token at
    least, so `history` rows before a cut are all that can be repeated after it.
    """
    spark, place = rows.sparkSession, work_dir(rows.sparkSession, "places")
    same = lambda a, b: a["conv_id"].eqNullSafe(b["_conv"])
    members = lambda how: rows.join(sized(long), rows["conv_id"].eqNullSafe(F.col("_long")), how)
    counts = members("left_semi").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    ranged = land(counts.repartitionByRange("conv_id", "turn").withColumn("part", F.spark_partition_id()), f"{place}/ranged")
    parts = ranged.groupBy(F.col("conv_id").alias("_conv"), F.col("part").alias("_part")).agg(F.sum("n").alias("sum"))
    before = F.sum("sum").over(W.partitionBy("_conv").orderBy("_part")) - F.col("sum")
    starts = ranged.join(parts.select("_conv", "_part", before.alias("before")), same(ranged, parts) & (F.col("part") == F.col("_part")))
    inside = F.sum("n").over(W.partitionBy("conv_id", "part").orderBy("turn")) - F.col("n")
    at = starts.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "n", (F.col("before") + inside).alias("start"))
    first, last = F.floor(F.col("start") / chunk), F.floor((F.col("start") + F.col("n") + history - 1) / chunk)
    at = land(at.select("_conv", "_turn", first.alias("_chunk"), F.when(last > first, F.sequence(first + 1, last)).alias("_later")), f"{place}/at")
    placed = members("left_semi").join(at, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")))
    own = placed.withColumn("chunk", F.col("_chunk")).select(rows.columns)
    carried = placed.filter("_later is not null").withColumn("chunk", F.explode("_later")).withColumn("new", F.lit(0)).select(rows.columns)
    # Only chunks that have rows of their own repeat anything. Their number is the rows' over `chunk`.
    chunks = land(at.select(F.col("_conv"), F.col("_chunk")).distinct(), f"{place}/chunks")
    carried = carried.join(chunks, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")), "left_semi")
    opening = own.filter("chunk = 0").groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("s")).filter("s.role = 'system'")
    systems = opening.join(chunks.filter("_chunk > 0"), F.col("conv_id").eqNullSafe(F.col("_conv")))
    systems = systems.select("conv_id", F.col("s.turn").alias("turn"), F.col("s.role").alias("role"), F.col("s.text").alias("text"), F.col("_chunk").alias("chunk"), F.lit(-1).alias("new"))
    return members("left_anti").unionByName(own).unionByName(carried).unionByName(systems)


def read_back(windows: DataFrame) -> DataFrame:
    """The contract's digests, from formatted windows alone: a stream over the windows of a conversation in order.

    A SHA-256 over a whole conversation is sequential, so each conversation's windows pass through one task; only the
    digest's state is held.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None

        def row() -> dict:
            return {"conv_id": now, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

        for frame in frames:
            out = []
            for conv, text, repeated, lows, highs in zip(frame["conv_id"], frame["formatted"], frame["n_repeated"], frame["loss_from"], frame["loss_to"], strict=True):
                conv = None if pd.isna(conv) else conv
                if state is None or conv != now:
                    if state is not None:
                        out.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(text)
                for role, said in turns_of(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for a, b in zip(lows, highs, strict=True):
                    said = unescape(text[a:b])
                    state[2] += len(said)
                    state[3].update(said.encode())
            if out:
                yield pd.DataFrame(out)
        if state is not None:
            yield pd.DataFrame([row()])

    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "window")
    return dealt.mapInPandas(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
