"""Repair of conversations: the cheapest edits that make the turns alternate, with faults counted on the way.

Rows are brought together by conversation and sorted by turn; no conversation is ever held. One pass over the Arrow batches
carries, across batches, a dynamic program over the four states of the form ``(s?(ua)+)?`` of role initials (nothing yet,
opened by s, after u, after a). Each state keeps its least cost, the rank of its edit letters among equal costs, and a running
SHA-256 of the repaired conversation, so no text is kept. What grows with a conversation is one backpointer of three bytes a
row; beyond ``SPILL`` bytes these go to an unnamed file of the task, like Spark's own sort spills, and are read backwards
once for the audit. If the executor is lost, so is the task, and it starts anew from the shuffled rows.

Edits: keep (0), rerole to user or assistant (2), delete (3; forced for blank and duplicate rows), insert an empty user or
assistant row (2); a truncated row that stays adds 1. In every state only one of u and a may come next, so the audit, the
edits' initials in order, fixes the repaired rows. Of equal costs the ASCII-least audit counts. Letters up to a row end with
that row's own letter and hold one such letter per row, so none of two such strings begins with the other, and comparing
(rank of the earlier letters, inserts and letter of this row) compares whole audits.

Duplicates are numbered by Spark within (conversation, role, text), on the same partitioning: one shuffle, two sorts that spill.

Defined results: conversations are named by ``conv_id``, of any type that Spark can order; null is one of them. Null role
and text count as one space. Rows of one turn are in order of role, then text; null turns come first. Dropped rows take no
part, but their conversation is returned. Only the first letter of a role counts for the form. An empty table gives no rows.
Extra columns are left out. Gaps beyond a long become the largest long.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurelake.llm.common import WORD, partitions, ship

#: Bytes of backpointers held in memory, and read back at a time.
SPILL, BACK = 3 << 20, 3 << 16
#: Costs of the edits.
RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_LONG = 2**63 - 1

# States: nothing yet, opened by s, after u, after a. By state, the rows that inserts put in and the state they lead to.
NAMES = {"u": "user", "a": "assistant"}
STEPS = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
INSERTS = [[("", 0), ("u", 2), ("ua", 3)], [("", 1), ("u", 2), ("ua", 3)], [("", 2), ("a", 3)], [("", 3), ("u", 2)]]
FINAL = (0, 3)
LETTERS = "DKR"


def _edits(initial: str, forced: bool, truncated: bool) -> list[list[tuple]]:
    """By state reached: (state before, cost, inserts and letter, inserted rows, role given) of each edit of a row."""
    found: list[list[tuple]] = [[] for _ in STEPS]
    late = TRUNCATED if truncated else 0
    for before, inserts in enumerate(INSERTS):
        for put, state in inserts:
            cost, letters = INSERT * len(put), "I" * len(put)
            found[state].append((before, cost + DELETE, letters + "D", put, None))
            if forced:
                continue
            for role, after in STEPS[state].items():
                if role == initial:
                    found[after].append((before, cost + late, letters + "K", put, ""))
                if role in NAMES:
                    found[after].append((before, cost + late + RETYPE, letters + "R", put, role))
    return found


#: By (initial, forced, truncated); any other initial is as good as none.
EDITS = {(i, f, t): _edits(i, f, t) for i in "sua-" for f in (False, True) for t in (False, True)}


class Conversation:
    """State carried along one conversation."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.rows = self.turns = 0
        self.low = self.high = self.turn = self.initial = None
        self.costs: list[int | None] = [0, None, None, None]
        self.ranks = [0] * len(STEPS)
        self.digests = [hashlib.sha256() for _ in STEPS]
        self.filled = [False] * len(STEPS)
        # Small conversations never touch a disk.
        self.back = tempfile.SpooledTemporaryFile(max_size=SPILL)

    def add(self, role: str, text: str, turn: int | None, blank: bool, repeated: bool, cut: bool) -> None:
        duplicate, cut = repeated and not blank, cut and not blank and not repeated
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += cut
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        initial = role[:1]
        self.illegal += self.rows > 0 and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self.rows += 1
        line = None
        best, pointers = [], 0
        for state, edits in enumerate(EDITS[initial if initial in ("s", "u", "a") else "-", blank or duplicate, cut]):
            found = None
            for edit in edits:
                before = self.costs[edit[0]]
                if before is not None:
                    value = (before + edit[1], self.ranks[edit[0]], edit[2])
                    if found is None or value < found[0]:
                        found = (value, edit)
            best.append(found)
            if found is not None:
                before, _, letters, _, _ = found[1]
                pointers |= (before | (len(letters) - 1) << 2 | (LETTERS.index(letters[-1]) + 1) << 4) << 6 * state
        digests, filled = [], []
        for found in best:
            if found is None:
                digests.append(None)
                filled.append(False)
                continue
            before, _, _, put, given = found[1]
            digest, some = self.digests[before], self.filled[before]
            lines = [f"{NAMES[p]}:".encode() for p in put]
            if given is not None:
                line = line or text.encode()
                lines.append((NAMES[given] if given else role).encode() + b":" + line)
            if lines:
                digest = digest.copy()
                digest.update((b"\n" if some else b"") + b"\n".join(lines))
                some = True
            digests.append(digest)
            filled.append(some)
        order = sorted({found[0][1:] for found in best if found is not None})
        self.ranks = [0 if found is None else order.index(found[0][1:]) for found in best]
        self.costs = [None if found is None else found[0][0] for found in best]
        self.digests, self.filled = digests, filled
        self.back.write(pointers.to_bytes(3, "little"))

    def result(self) -> dict:
        ends = [(cost + INSERT * len(put), self.ranks[state], len(put), state, put)
                for state, cost in enumerate(self.costs) if cost is not None for put, after in INSERTS[state] if after in FINAL]
        cost, _, _, state, put = min(ends)
        digest = self.digests[state].copy()
        lines = [f"{NAMES[p]}:".encode() for p in put]
        if lines:
            digest.update((b"\n" if self.filled[state] else b"") + b"\n".join(lines))
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, _LONG)
        out = {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
               "cost": cost, "audit": self.audit(state) + "I" * len(put), "repaired_sha256": digest.hexdigest()}
        self.back.close()
        return out

    def audit(self, state: int) -> str:
        """Letters of the cheapest edits up to the last row, from the backpointers, last row first."""
        parts, end = [], 3 * self.rows
        while end:
            start = max(0, end - BACK)
            self.back.seek(start)
            data, letters = self.back.read(end - start), []
            for at in range(len(data) - 3, -1, -3):
                one = int.from_bytes(data[at:at + 3], "little") >> 6 * state & 63
                letters.append(LETTERS[(one >> 4) - 1] + "I" * (one >> 2 & 3))
                state = one & 3
            parts.append("".join(letters))
            end = start
        return "".join(parts)[::-1]


OUT = ("key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
       "repaired_sha256 string")


def repair_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each conversation of sorted rows (fresh, key, live, role, text, no_turn, turn, blank, repeated, cut)."""
    current = key = None
    for frame in frames:
        done = []
        columns = [frame[c].tolist() for c in ("key", "first", "live", "role", "text", "no_turn", "turn", "blank", "repeated", "cut")]
        for name, first, live, role, text, no_turn, turn, blank, repeated, cut in zip(*columns):
            if first:
                if current is not None:
                    done.append({"key": key, **current.result()})
                current, key = Conversation(), name
            if live:
                current.add(role, text, None if no_turn else turn, blank, repeated, cut)
        if done:
            yield pd.DataFrame(done)
    if current is not None:
        yield pd.DataFrame([{"key": key, **current.result()}])


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", live: str | None = None) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired rows of every conversation of rows conv, turn, role, text.

    Rows whose column ``live`` is false only name their conversation.
    """
    kind = rows.schema[conv].dataType
    here = F.coalesce(F.col(live), F.lit(False)) if live else F.lit(True)
    named = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("at"), here.alias("live"),
        F.when(here, F.coalesce("role", F.lit(" "))).otherwise("").alias("role"),
        F.when(here, F.coalesce("text", F.lit(" "))).otherwise("").alias("text"))
    same = Window.partitionBy("conv", F.xxhash64("role", "text"), "live", "role", "text")
    inside = Window.partitionBy("conv")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    told = (named.repartition(partitions(rows), "conv")
            .withColumn("repeated", F.row_number().over(same.orderBy(F.col("at").asc_nulls_first())) > 1)
            .withColumn("first", F.row_number().over(inside.orderBy(F.col("at").asc_nulls_first(), "role", "text", "live", "repeated")) == 1)
            .select(F.col("conv").cast("string").alias("key"), "first", "live", "role", "text", F.col("at").isNull().alias("no_turn"),
                    F.coalesce("at", F.lit(0)).alias("turn"), (~F.col("text").rlike(WORD)).alias("blank"), "repeated",
                    (~last.isin(".", "!", "?")).alias("cut")))
    return ship(told).mapInPandas(repair_batches, OUT).withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", conv)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, chosen by crc32 of ``conv_id:turn`` modulo 20: dropped (live is false), emptied, without
    sentence ends, twice in a row, or given to the user."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(name.cast("binary")) % 20
    return rows.select("conv_id", "turn", fault.alias("fault"), role.alias("role"), text.alias("text")).select(
        "conv_id", "turn", (F.col("fault") != 0).alias("live"),
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
