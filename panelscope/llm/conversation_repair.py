"""Repair of damaged conversations at the least cost, streamed in secondary-sorted order.

A conversation's rows become ``(s?(ua)+)?`` (an optional system row, then user and assistant in
turn, or nothing) by the cheapest edits: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an
empty row 3; a blank or repeated row must go, a truncated one that stays adds 3. Of equally cheap
edit sequences the ASCII-least one is taken.

The rows are partitioned by conversation and sorted twice over: first each conversation's rows in
falling order of their places, without their texts, then in rising order with them. ``mapInPandas``
passes over both and carries its state across Arrow batches. The falling pass is the dynamic program:
four costs (start, after system, after user, after assistant) of repairing what follows, and per row
one byte, the ASCII-least cheapest edit out of each of the four states. The bytes are the
backpointers, a stack that goes to a spill file beyond SPILL bytes, so a giant conversation needs no
more memory than a small one. The rising pass takes the bytes back, follows the edits from the start
and hashes the repaired rows as they come. A conversation is one task's work (its hash is a chain
over all its rows), but none of its rows is held; there is one shuffle, of the rows themselves.

Edge cases: nulls in role and text are one space, a null conversation is one of its own, null turns
come first; rows of one turn are ordered by role, then text; repeated rows are rows; a conversation
whose rows were all dropped comes back with zeros, an empty audit and the hash of the empty string;
a role counts by its first letter (an empty one has none and is never kept); texts of any length are hashed whole;
further columns are not read; no rows give no conversations.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWING = (USER, USER, ASSISTANT, USER)  # the state after an inserted or reroled row
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
EDITS = "DIKR"  # in ASCII order; an edit is its place here, two bits of a backpointer
NEVER = 1 << 40
END_COSTS = (0, 2 * INSERT, INSERT, 0)  # after the last row
END_EDITS = (None, "I", "I", None)
LEGAL = ("su", "ua", "au")
FINE, IS_BLANK, IS_REPEATED, IS_TRUNCATED = range(4)
SPILL = 1 << 22  # backpointer bytes held in memory
FALLING, RISING, DROPPED = range(3)  # kinds of streamed rows
REPORT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "conv string, place long, edit string, role string, text string"


@lru_cache(maxsize=1 << 14)
def edit_step(after: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int, int]:
    """``after``: costs of what follows a row, by state, less their minimum. Returns the costs
    from before the row in the same form, what was taken off them, and the backpointer."""
    stays = fault in (FINE, IS_TRUNCATED)
    extra = TRUNCATED if fault == IS_TRUNCATED else 0
    options: list[dict[str, int]] = []
    for state in range(4):
        of = {"D": DELETE + after[state]}
        if stays:
            if (state, initial) in KEPT:
                of["K"] = extra + after[KEPT[state, initial]]
            of["R"] = extra + REROLE + after[FOLLOWING[state]]
        options.append(of)
    plain = [min(of.values()) for of in options]
    costs = [0] * 4
    costs[USER] = min(plain[USER], INSERT + plain[ASSISTANT])
    costs[ASSISTANT] = min(plain[ASSISTANT], INSERT + plain[USER])
    for state in (START, SYSTEM):
        costs[state] = min(plain[state], INSERT + costs[USER])
    byte = 0
    for state, of in enumerate(options):
        of["I"] = INSERT + costs[FOLLOWING[state]]
        byte |= EDITS.index(min(e for e, cost in of.items() if cost == costs[state])) << 2 * state
    base = min(costs)
    return tuple(c - base for c in costs), base, byte


class ByteStack:
    """A stack of bytes; beyond ``limit`` its lower part is in a file that is gone with the task."""

    def __init__(self, limit: int = SPILL):
        self.limit, self.top, self.below, self.spilled = limit, bytearray(), None, 0

    def push(self, byte: int) -> None:
        self.top.append(byte)
        if len(self.top) > self.limit:
            if self.below is None:
                self.below = tempfile.TemporaryFile()
            half = len(self.top) // 2
            self.below.seek(self.spilled)
            self.below.write(self.top[:half])
            self.spilled += half
            del self.top[:half]

    def pop(self) -> int:
        if not self.top:
            take = min(self.spilled, max(1, self.limit // 2))
            self.spilled -= take
            self.below.seek(self.spilled)
            self.top += self.below.read(take)
        return self.top.pop()

    def close(self) -> None:
        if self.below is not None:
            self.below.close()


class Repair:
    """One conversation: its rows falling (``judge``), then rising (``follow``), then ``finish``."""

    def __init__(self, spill: int = SPILL):
        self.pointers = ByteStack(spill)
        self.after, self.taken = END_COSTS, 0
        self.state, self.audit, self.hash, self.rows = START, [], hashlib.sha256(), 0
        self.faults, self.illegal, self.last = [0] * 4, 0, None
        self.turns, self.first_turn, self.last_turn = 0, None, None
        self.written: list[tuple] = []

    def judge(self, initial: str, fault: int) -> None:
        self.after, base, byte = edit_step(self.after, initial, fault)
        self.taken += base
        self.pointers.push(byte)

    def _write(self, edit: str, role: str, text: str) -> None:
        self.hash.update((("\n" if self.rows else "") + role + ":" + text).encode("utf-8"))
        self.written.append((self.rows, edit, role, text))
        self.rows += 1

    def _insert(self) -> None:
        self.state = FOLLOWING[self.state]
        self.audit.append("I")
        self._write("I", ROLES[self.state], "")

    def follow(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        initial = role[:1]
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        byte = self.pointers.pop()
        while (edit := EDITS[byte >> 2 * self.state & 3]) == "I":
            self._insert()
        self.audit.append(edit)
        if edit == "K":
            self.state = KEPT[self.state, initial]
            self._write("K", role, text)
        elif edit == "R":
            self.state = FOLLOWING[self.state]
            self._write("R", ROLES[self.state], text)

    def finish(self) -> tuple:
        while END_EDITS[self.state]:
            self._insert()
        self.pointers.close()
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        cost = self.taken + self.after[START]
        return (gaps, *self.faults[1:], self.illegal, cost, "".join(self.audit), self.hash.hexdigest())


def damage(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, dropped: the rows with the faults that their key's CRC-32 asks for."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    read = conversations.select(
        F.col("conv_id").cast("string").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("fault"),
    )
    fault = F.col("fault")
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return read.select(
        "conv",
        "turn",
        F.when(fault == 0, "").when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault.isin(0, 1), "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (fault == 0).alias("dropped"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def streamed(damaged: DataFrame) -> DataFrame:
    """The rows in the order that ``Repair`` takes them, whole conversations in a partition."""
    dealt = damaged.repartition("conv")
    stripped = F.rtrim("text", F.lit(BLANKS))
    seen = F.row_number().over(Window.partitionBy("conv", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    place = F.row_number().over(Window.partitionBy("conv").orderBy("dropped", F.col("turn").asc_nulls_first(), "role", "text", "seen"))
    judged = dealt.withColumn("seen", seen).withColumn("place", place)
    fault = (
        F.when(stripped == "", IS_BLANK)
        .when(F.col("seen") > 1, IS_REPEATED)
        .when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), IS_TRUNCATED)
        .otherwise(FINE)
    )
    kinds = F.when(F.col("dropped"), F.array(F.lit(DROPPED))).otherwise(F.array(F.lit(FALLING), F.lit(RISING)))
    both = judged.select("conv", "turn", "role", "text", fault.alias("fault"), "place", F.explode(kinds).alias("kind"))
    falling = F.col("kind") == FALLING
    return both.select(
        "conv",
        "kind",
        F.when(falling, -F.col("place")).otherwise(F.col("place")).alias("nth"),
        F.coalesce("turn", F.lit(0)).alias("turn"),
        F.col("turn").isNull().alias("no_turn"),
        F.when(falling, F.substring("role", 1, 1)).otherwise(F.col("role")).alias("role"),
        F.when(falling, F.lit("")).otherwise(F.col("text")).alias("text"),
        "fault",
    ).sortWithinPartitions("conv", "kind", "nth")


def _passes(with_rows: bool):
    schema = ROWS if with_rows else REPORT
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, current = None, None
        for batch in batches:
            out: list[tuple] = []
            columns = [batch[c].tolist() for c in ("conv", "kind", "turn", "no_turn", "role", "text", "fault")]
            for row_conv, kind, turn, no_turn, role, text, fault in zip(*columns, strict=True):
                if current is None or row_conv != conv:
                    out += closed(conv, current)
                    conv, current = row_conv, Repair()
                if kind == FALLING:
                    current.judge(role, fault)
                elif kind == RISING:
                    current.follow(None if no_turn else turn, role, text, fault)
                    out += taken(conv, current)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(closed(conv, current), columns=names)

    def taken(conv, repair: Repair) -> list[tuple]:
        rows, repair.written = repair.written, []
        return [(conv, *row) for row in rows] if with_rows else []

    def closed(conv, repair: Repair | None) -> list[tuple]:
        if repair is None:
            return []
        report = repair.finish()
        return taken(conv, repair) if with_rows else [(conv, *report)]

    return run, schema


def _streamed_through(damaged: DataFrame, with_rows: bool, kind) -> DataFrame:
    run, schema = _passes(with_rows)
    found = streamed(damaged).mapInPandas(run, schema)
    return found.select(F.col("conv").cast(kind).alias("conv_id"), *[c for c in found.columns if c != "conv"])


def repair_reports(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256, of ``conversations`` (conv_id, turn, role, text) after ``damage``."""
    return _streamed_through(damage(conversations), False, conversations.schema["conv_id"].dataType)


def repaired_rows(conversations: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 0), edit (K, R or I), role, text."""
    return _streamed_through(damage(conversations), True, conversations.schema["conv_id"].dataType)
