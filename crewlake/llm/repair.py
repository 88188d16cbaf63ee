"""Repair of damaged conversations by the cheapest edits, as a secondary-sorted stream.

Rows are dealt by conversation and sorted by turn; a task reads its conversations row by row, whatever Arrow batch they lie
in, and carries the state of a dynamic programme with it: for each of four grammar states the least cost, the rank of its
edits among the states (ties go to the least audit in ASCII order) and the running hash of the repaired rows.  What may end
a conversation is ``(s?(ua)+)?``: nothing, or user and assistant in turn, after a system row or not.

Going back needs, per row, which state and edit each state came from: four bytes.  A conversation of more than ``BLOCK`` rows
spills them: each full block leaves the task as a row of the stored result, so a task holds one block, and a second stream,
sorted the other way, reads the blocks back and spells the audit.  Nothing lies on a machine's own disk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewlake.llm.shared import stored

BLOCK = 1 << 16
_NON_BLANK = r"[^\x20\x09-\x0D]"
#: Grammar states: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that a state calls for.
CALLS = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
EDITS = ("D", "IK", "IR", "K", "R")
_FAR = 1 << 60


def damage(rows: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn") -> DataFrame:
    """Rows (conv, turn, role, text, gone): a fixed share of rows dropped, emptied, cut, repeated or given another role.

    Decided by the row's id and turn alone.  NULL roles and texts become one space.  Dropped rows stay, marked as gone, so
    that no conversation is lost.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_column, turn_column)])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        F.col(conv_column).alias("conv"), F.col(turn_column).alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def _flags() -> dict[str, Column]:
    blank = ~F.col("text").rlike(_NON_BLANK)
    again = F.row_number().over(Window.partitionBy("conv", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return {"fault": F.when(F.col("gone"), -1).when(blank, 1).when(again, 2).when(~whole, 3).otherwise(0)}


def _moves() -> dict[tuple[str, bool, bool], list[list[tuple[int, int, str, int, int]]]]:
    """By (initial, must go, truncated) and state reached: (state before, cost, edit, code, its place among the edits)."""
    out = {}
    for initial in ("s", "u", "a", ""):
        for gone in (False, True):
            for cut in (False, True):
                into: list[list[tuple[int, int, str, int, int]]] = [[] for _ in range(4)]
                for state in range(4):
                    for place, edit in enumerate(EDITS):
                        at, cost = state, 0
                        if edit == "D":
                            cost = DELETE
                        elif gone:
                            continue
                        else:
                            if edit[0] == "I":
                                at, cost = NEXT[at, CALLS[at][0]], INSERT
                            symbol = CALLS[at][0] if edit[-1] == "R" else initial
                            if (at, symbol) not in NEXT:
                                continue
                            at = NEXT[at, symbol]
                            cost += REROLE * (edit[-1] == "R") + TRUNCATED * cut
                        into[at].append((state, cost, edit, state * 8 + place, place))
                out[initial, gone, cut] = into
    return out


MOVES = _moves()
_LEGAL = {"su", "ua", "au"}


class Stream:
    """State of one conversation: the best way into each grammar state, and counts."""

    def __init__(self) -> None:
        self.cost = [0, _FAR, _FAR, _FAR]
        self.rank = [0, 1, 2, 3]
        self.text = [hashlib.sha256() for _ in range(4)]
        self.back = bytearray()
        self.blocks = 0
        self.faults = [0, 0, 0, 0]
        self.illegal, self.turns, self.low, self.last = 0, 0, None, None
        self.role: str | None = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if fault < 0:
            return
        if turn is not None:
            self.turns += turn != self.last
            self.low = turn if self.low is None else self.low
            self.last = turn
        self.faults[fault] += 1
        initial = role[:1]
        if self.role is not None:
            self.illegal += self.role + initial not in _LEGAL
        self.role = initial
        moves = MOVES[initial if initial in ("s", "u", "a") else "", fault in (1, 2), fault == 3]
        cost, order, text_of = [_FAR] * 4, [], [None] * 4
        for state in range(4):
            best = None
            for before, price, edit, code, place in moves[state]:
                if self.cost[before] < _FAR:
                    found = (self.cost[before] + price, self.rank[before], place, before, edit, code)
                    if best is None or found < best:
                        best = found
            if best is None:
                self.back.append(255)
                continue
            total, rank, place, before, edit, code = best
            self.back.append(code)
            cost[state] = total
            order.append((rank, place, state))
            said = self.text[before].copy()
            if edit != "D":
                at = before
                if edit[0] == "I":
                    said.update(f"{self._line(at)}{CALLS[at]}:".encode())
                    at = NEXT[at, CALLS[at][0]]
                said.update(f"{self._line(at)}{CALLS[at] if edit[-1] == 'R' else role}:{text}".encode())
            text_of[state] = said
        self.cost, self.text = cost, [t or hashlib.sha256() for t in text_of]
        for k, (_, _, state) in enumerate(sorted(order)):
            self.rank[state] = k

    @staticmethod
    def _line(state: int) -> str:
        return "" if state == START else "\n"

    def end(self) -> tuple[int, int, str, str]:
        """(cost, state before the closing inserts, those inserts, hash of the repaired rows)."""
        more = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
        total, _, state = min((self.cost[s] + INSERT * more[s], self.rank[s], s) for s in range(4) if self.cost[s] < _FAR)
        said, at = self.text[state], state
        for _ in range(more[state]):
            said.update(f"\n{CALLS[at]}:".encode())
            at = NEXT[at, CALLS[at][0]]
        return total, state, "I" * more[state], said.hexdigest()


def spell(back: bytes | bytearray, state: int) -> tuple[str, int]:
    """Edits of a block of rows that ends in ``state``, and the state before it."""
    out = []
    for k in range(len(back) - 4, -1, -4):
        code = back[k + state]
        out.append(EDITS[code & 7][::-1])
        state = code >> 3
    return "".join(out)[::-1], state


_RESULT = "conv string, block long, back binary, state int, tail string, audit string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, hash string"


def _forward(batches: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """A row per full block of a conversation (back pointers), and one at its end (the last ones and all counts)."""
    now: Stream | None = None
    conv: str | None = None
    names = [c.split()[0] for c in _RESULT.split(", ")]
    out: list[tuple] = []

    def closed() -> tuple:
        total, state, tail, said = now.end()
        gaps = 0 if now.low is None else now.last - now.low + 1 - now.turns
        audit, back = (None, bytes(now.back)) if now.blocks else (spell(now.back, state)[0] + tail, b"")
        return (conv, now.blocks, back, state, tail, audit, gaps, *now.faults[1:], now.illegal, total, said)

    for rows in batches:
        for key, none, turn, no_turn, role, text, fault in zip(*[rows[c].tolist() for c in ("conv", "none", "turn", "no_turn", "role", "text", "fault")]):
            key = None if none else key
            if now is None or key != conv:
                if now is not None:
                    out.append(closed())
                now, conv = Stream(), key
            now.add(None if no_turn else turn, role, text, fault)
            if len(now.back) >= 4 * block:
                out.append((conv, now.blocks, bytes(now.back), *[None] * 10))
                now.blocks += 1
                now.back.clear()
                yield pd.DataFrame(out, columns=names, dtype=object)
                out = []
        if len(out) >= 1024:
            yield pd.DataFrame(out, columns=names, dtype=object)
            out = []
    if now is not None:
        out.append(closed())
    if out:
        yield pd.DataFrame(out, columns=names, dtype=object)


def _backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Audits of spilled blocks, which come in descending order; the state passes from a block to the one before it."""
    state = 0
    for rows in batches:
        out = []
        for conv, block, back, given, tail in zip(*[rows[c].tolist() for c in ("conv", "block", "back", "state", "tail")]):
            if tail is not None:  # the end of the next conversation
                state = int(given)
            audit, state = spell(bytes(back), state)
            out.append((conv, block, audit + (tail or "")))
        yield pd.DataFrame(out, columns=["conv", "block", "part"])


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one per conversation.

    ``rows`` has (conv, turn, role, text, gone), as :func:`damage` gives it; rows marked as gone only keep their conversation
    in the result, NULL roles and texts are one space.  A conversation's rows are taken by turn, NULL first, then by role and text, so equal turns have a defined
    order.  A NULL conversation is one of its own.  Blank and repeated rows must go, others may be kept, given another role
    or deleted, and empty rows inserted.  A conversation without rows costs nothing and has an empty audit.  An empty table
    gives no rows.  An audit is one text, so a conversation may have up to about 10**9 rows.
    """
    kind = rows.schema["conv"].dataType
    # one shuffle: the windows and the stream all need a conversation's rows together
    words = {c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")}
    dealt = rows.withColumns(words).repartition("conv").withColumns(_flags())
    turns = dealt.select(F.col("conv"), F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("name"), F.col("conv").isNull().alias("none"),
                         F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"), "role", "text", "fault")
    ordered = turns.sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("no_turn").desc(), "turn", "role", "text", F.col("fault") == 2).select(
        F.col("name").alias("conv"), "none", "turn", "no_turn", "role", "text", "fault")
    found = stored(ordered.mapInPandas(lambda batches: _forward(batches, block), _RESULT))
    spilled = found.filter("audit IS NULL")
    parts = spilled.repartition("conv").sortWithinPartitions("conv", F.col("block").desc()).select("conv", "block", "back", "state", "tail").mapInPandas(
        _backward, "conv string, block long, part string")
    audits = parts.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "part"))), lambda x: x["part"]), "").alias("audit"))
    ends = spilled.filter("tail IS NOT NULL").drop("audit").join(audits.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    return found.filter("audit IS NOT NULL").unionByName(ends).select(F.col("conv").cast(kind).alias("conv"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                          F.col("hash").alias("repaired_sha256"))
