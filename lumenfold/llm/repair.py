"""Conversation repair: cheapest edits that make the roles of a conversation alternate, by a weighted automaton determinised as it is used.

States of the automaton of `(s?(ua)+)?`: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a. What is left to pay
from each state is a vector of four costs; less its smallest, it is a state of the determinised automaton. There
are few of them, since inserts lead from any state to any other at a bounded cost, and they and the moves
between them are put into a table the first time they occur. Conversations are scanned from their end
through this table, which gives costs; the arcs that are tight, traced from the first row on, give the edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize

INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
ENDS = (0, 6, 3, 0)  # what is left to pay behind the last row
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = "uuau"  # the role that an insert or a change brings in each state
NAMES = {"u": "user", "a": "assistant"}
BLANK, DUPLICATE, CUT, FINE = 1, 2, 3, 4


class Machine:
    """The determinised automaton, as far as it has been needed."""

    def __init__(self) -> None:
        self.states: list[tuple[int, ...]] = [ENDS]
        self.known: dict[tuple[int, ...], int] = {ENDS: 0}
        self.moves: dict[tuple[int, str], tuple[int, int]] = {}
        self.arcs: dict[tuple[int, str, int], tuple[str, int]] = {}

    def _costs(self, left: tuple[int, ...], row: str) -> tuple[list[int], list[list[tuple[str, int, int]]]]:
        """Costs before a row, if those behind it are `left`, and its ways out of each state: (edit, cost, next state)."""
        ways = []
        for q in range(4):
            out = [("D", DELETE, q)]
            if row != "-":
                more = TRUNCATED if row.isupper() else 0
                if (q, row.lower()) in STEP:
                    out.append(("K", more, STEP[q, row.lower()]))
                out.append(("R", REROLE + more, STEP[q, WANTED[q]]))
            ways.append(out)
        costs = [min(c + left[to] for _, c, to in out) for out in ways]
        for _ in range(3):
            costs = [min(costs[q], INSERT + costs[STEP[q, WANTED[q]]]) for q in range(4)]
        return costs, ways

    def move(self, state: int, row: str) -> tuple[int, int]:
        """The state before a row and what it adds to the cost, given the state behind it."""
        if (state, row) not in self.moves:
            costs, _ = self._costs(self.states[state], row)
            least = min(costs)
            vector = tuple(c - least for c in costs)
            if vector not in self.known:
                self.known[vector] = len(self.states)
                self.states.append(vector)
            self.moves[state, row] = self.known[vector], least
        return self.moves[state, row]

    def arc(self, state: int, row: str, q: int) -> tuple[str, int]:
        """The least letters of tight arcs from q that consume a row, given the state behind it, and where they lead."""
        if (state, row, q) not in self.arcs:
            left, letters, at = self.states[state], "", q
            costs, ways = self._costs(left, row)
            while True:
                tight = [(edit, to) for edit, c, to in ways[at] if c + left[to] == costs[at]]
                if costs[at] == INSERT + costs[STEP[at, WANTED[at]]]:
                    tight.append(("I", STEP[at, WANTED[at]]))
                edit, at = min(tight)
                letters += edit
                if edit != "I":
                    break
            self.arcs[state, row, q] = letters, at
        return self.arcs[state, row, q]

    def repair(self, rows: str) -> tuple[int, str]:
        """Cost and audit of a conversation whose rows are given by a letter each: s, u, a or another, upper case if truncated, - if it must go."""
        cost, behind, state = 0, [], 0
        for row in reversed(rows):
            behind.append(state)
            state, more = self.move(state, row)
            cost += more
        cost += self.states[state][0]
        audit, q = [], 0
        for row, state in zip(rows, reversed(behind)):
            letters, q = self.arc(state, row, q)
            audit.append(letters)
        audit.append("I" * (ENDS[q] // INSERT))
        return cost, "".join(audit)


MACHINE = Machine()


SPACE = r"[\x20\x09-\x0D]"


def damage(conversations: DataFrame) -> DataFrame:
    """conversations as messages for `audit_conversations`, one row in four damaged by the CRC-32 of conv_id:turn, modulo 20.

    0 drops a row (times 0, so that its conversation stays known), 1 empties its text, 2 takes .!? out of it,
    3 repeats it (times 2), 4 makes its role user. A null conv_id or turn reads as one space in that key, a null
    role or text is one space; a null conv_id is a conversation of its own.
    """
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    how = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return conversations.select(
        "conv_id", "turn", F.when(how == 4, "user").otherwise(role).alias("role"),
        F.when(how == 1, "").when(how == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(how == 0, 0).when(how == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def _keyed(messages: DataFrame) -> DataFrame:
    """messages with conv_id as text, nulls of turn set apart, and each text's hash. A conversation's order is timed, turn, role, digest."""
    return messages.select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").isNotNull().alias("timed"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.unhex(F.sha2(F.coalesce("text", F.lit(" ")), 256)).alias("digest"), "times",
    )


ORDER = ["timed", "turn", "role", "digest"]


def faulty_rows(keyed: DataFrame) -> DataFrame:
    """keyed messages without text, equal ones of a turn as one row with their `times`, and with the fault of the first of them.

    The first fault of a row counts: blank, then duplicate (its conversation has its role and text earlier),
    then truncated (its last character that is no space isn't one of .!?). The others of equal rows are
    duplicates unless blank. Roles and texts that a conversation has in many turns are found by partial
    aggregates; those that fill many rows are broadcast by their hash.
    """
    last = F.regexp_extract("text", rf"({SPACE.replace('[', '[^')}){SPACE}*\z", 1)
    own = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(CUT)
    conv = F.struct("conv_id").alias("conv")
    rows = materialize(keyed.groupBy(conv, *ORDER, own.alias("own")).agg(F.sum("times").alias("times")))
    said = rows.filter((F.col("own") != BLANK) & (F.col("times") > 0)).select("conv", *ORDER)
    groups = said.groupBy("conv", "role", "digest").agg(F.count("*").alias("n"), F.min(F.struct("timed", "turn")).alias("first"))
    often = materialize(groups.filter("n > 1"))
    later = join_hot(said, often, ["conv", "role", "digest"], "n", rows.count()).filter(F.struct("timed", "turn") > F.col("first"))
    rows = rows.join(later.select("conv", *ORDER, F.lit(True).alias("later")), ["conv", *ORDER], "left")
    return rows.select("conv.conv_id", *ORDER, "times", F.when((F.col("own") != BLANK) & F.col("later"), DUPLICATE).otherwise(F.col("own")).alias("fault"))


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by conversation and place -> a row each conversation. Of a row one letter is kept until its conversation ends."""
    conv, s, out = None, None, []

    def close() -> None:
        cost, audit = MACHINE.repair("".join(s["letters"]))
        gaps = s["most"] - s["least"] + 1 - s["turns"] if s["turns"] else 0
        out.append((conv, gaps, *s["faults"][1:4], s["illegal"], cost, audit))

    def table() -> pd.DataFrame:
        return pd.DataFrame(out, columns=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    for batch in batches:
        out = []
        for now, timed, turn, initial, letter, fault, times in zip(*[batch[c].tolist() for c in ("conv_id", "timed", "turn", "initial", "letter", "fault", "times")]):
            if s is None or now != conv:
                if s is not None:
                    close()
                conv, s = now, {"letters": [], "faults": [0] * 5, "illegal": 0, "last": None, "least": 0, "most": None, "turns": 0}
            if not times:
                continue
            s["faults"][fault] += 1
            s["faults"][BLANK if fault == BLANK else DUPLICATE] += times - 1
            s["letters"].append(letter + "-" * (times - 1))
            s["illegal"] += (s["last"] is not None and s["last"] + initial not in ("su", "ua", "au")) + times - 1
            s["last"] = initial
            if timed and turn != s["most"]:
                s["least"], s["most"], s["turns"] = s["least"] if s["turns"] else turn, turn, s["turns"] + 1
        yield table()
    out = []
    if s is not None:
        close()
        yield table()


def audit_conversations(messages: DataFrame) -> DataFrame:
    """Per conv_id (as text): gaps, blank, duplicate, truncated, illegal, cost and audit.

    messages: conv_id, turn, role, text, times (how many equal rows stand there; 0 only makes the conversation known).
    Faults: `faulty_rows`. gaps: turns missing between the smallest and the largest. illegal: neighbours whose initials
    aren't su, ua or au. A row is kept (K, 0), given the role user or assistant (R, 3) or deleted (D, 4; blank
    and duplicate rows must be), an empty row of either role is inserted (I, 3), and a truncated row that
    stays costs 3 more; audit is the least text among the cheapest edits that leave initials of the form
    (s?(ua)+)?. Any other initial, and an empty role, can't be kept. Rows stand by turn (nulls first), role and hash
    of text. Nulls of role and text are one space, a null conv_id is a conversation. A conversation passes through one
    task, a letter for each of its rows in memory, as its audit is one text. An empty table gives an empty result.
    """
    rows = faulty_rows(_keyed(messages))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("fault").isin(BLANK, DUPLICATE), "-").when(F.col("fault") == CUT, F.upper(known)).otherwise(known)
    rows = rows.select("conv_id", *ORDER, "times", "fault", initial.alias("initial"), letter.alias("letter"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    return rows.mapInPandas(_summaries, "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


class _Reader:
    """Reads an audit along the rows of its conversation."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.q = audit, 0, 0

    def inserts(self) -> list[tuple[str, str]]:
        out = []
        while self.audit[self.at : self.at + 1] == "I":
            role = NAMES[WANTED[self.q]]
            out.append(("I", role))
            self.q, self.at = STEP[self.q, role[0]], self.at + 1
        return out

    def row(self, role: str) -> tuple[str, str]:
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            role = NAMES[WANTED[self.q]] if edit == "R" else role
            self.q = STEP[self.q, role[0]]
        return edit, role


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(conversation, edit, role, text, new) along sorted pieces: new rows open with new = True, their further pieces don't; None for edit ends a conversation."""
    reader, conv, row = None, None, None

    def end() -> Iterator[tuple]:
        if reader is not None:
            yield from ((conv, edit, role, "", True) for edit, role in reader.inserts())
            yield conv, None, "", "", False

    for batch in batches:
        for now, head, audit, timed, turn, role, digest, piece, text, times in zip(*[batch[c].tolist() for c in ("conv_id", "head", "audit", *ORDER, "piece", "part", "times")]):
            if head:
                yield from end()
                reader, conv, row = _Reader(audit), now, None
                continue
            if piece == 0:
                for _ in range(times):
                    yield from ((conv, edit, name, "", True) for edit, name in reader.inserts())
                    edit, name = reader.row(role)
                    # equal rows stand side by side, and all but the first are deleted
                    if row is None or row[0] != (timed, turn, role, digest):
                        row = [(timed, turn, role, digest), edit != "D", 0]
                        if row[1]:
                            yield conv, edit, name, text, True
            elif row[1] and piece == row[2] + 1:
                row[2] = piece
                yield conv, "", "", text, False
    yield from end()


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out, digest, first = [], hashlib.sha256(), True
    for conv, edit, role, text, new in _repaired(batches):
        if edit is None:
            out.append((conv, digest.hexdigest()))
            digest, first = hashlib.sha256(), True
            if len(out) == 4096:
                yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"])
                out = []
            continue
        if new:
            digest.update(f"{'' if first else chr(10)}{role}:".encode())
            first = False
        digest.update(text.encode())
    yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"])


def _turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out, at, part, size = [], -1, 0, 0
    columns = ["conv_id", "at", "part", "edit", "role", "text"]
    for conv, edit, role, text, new in _repaired(batches):
        if edit is None:
            at = -1
            continue
        at, part = (at + 1, 0) if new else (at, part + 1)
        out.append((conv, at, part, edit or None, role or None, text))
        size += len(text)
        if size > 1 << 24 or len(out) == 4096:
            yield pd.DataFrame(out, columns=columns)
            out, size = [], 0
    yield pd.DataFrame(out, columns=columns)


def _along(messages: DataFrame, audits: DataFrame, points: int) -> DataFrame:
    """Each conversation's audit and behind it its rows in order, texts in pieces of so many code points. Texts are shuffled once."""
    keyed = _keyed(messages).filter("times > 0")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / points) - 1, F.lit(0)).cast("int")), lambda k: F.substring(F.col("text"), k * points + 1, F.lit(points)))
    rows = keyed.select("conv_id", F.lit(False).alias("head"), *ORDER, "times", F.posexplode(pieces).alias("piece", "part"))
    head = {"head": F.lit(True), "audit": F.col("audit"), "timed": F.lit(False), "turn": F.lit(0).cast("long"), "role": F.lit(""), "digest": F.lit(b""), "times": F.lit(0).cast("long"), "piece": F.lit(0), "part": F.lit("")}
    heads = audits.select("conv_id", *[c.alias(name) for name, c in head.items()])
    both = heads.unionByName(rows.withColumn("audit", F.lit(None).cast("string")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), *ORDER, "piece")


def repaired_hashes(messages: DataFrame, audits: DataFrame, points: int = 4096) -> DataFrame:
    """conv_id and repaired_sha256, of `role:text` of the repaired rows joined by new lines. Texts stream through the hash."""
    return _along(messages, audits, points).mapInPandas(_hashes, "conv_id string, repaired_sha256 string")


def repaired_turns(messages: DataFrame, audits: DataFrame, points: int = 4096) -> DataFrame:
    """The repaired conversations: conv_id, at (place from 0), part, edit, role and text. Texts longer than `points` go on in further parts, without edit and role."""
    return _along(messages, audits, points).mapInPandas(_turns, "conv_id string, at long, part int, edit string, role string, text string")


def repair_conversations(messages: DataFrame) -> DataFrame:
    """What `audit_conversations` gives, with repaired_sha256 (see `repaired_hashes`); conv_id has the type it has in messages."""
    audits = materialize(audit_conversations(messages))
    hashes = repaired_hashes(messages, audits).withColumnRenamed("conv_id", "_id")
    both = audits.join(hashes, audits["conv_id"].eqNullSafe(hashes["_id"])).drop("_id")
    return both.withColumn("conv_id", F.col("conv_id").cast(messages.schema["conv_id"].dataType))
