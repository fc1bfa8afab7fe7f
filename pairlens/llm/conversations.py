"""Repair of conversations: the cheapest edits that give an optional system turn and then user and assistant in turn.

A conversation's turns must have the initials `(s?(ua)+)?`. A turn is kept (0), given the other role
(3) or deleted (4); a turn without text may be inserted anywhere (3). Blank turns and repeats of an
earlier turn of the conversation must be deleted; turns whose text ends without `.`, `!` or `?` cost
3 more unless deleted. Which edits are cheapest is found by the cost to go from each state of the grammar
(nothing yet, after system, after user, after assistant), from the last turn to the first; a walk
from the first turn on then takes, among the edits that are tight, the one whose initial (D, I, K, R)
comes first.

Turns go to the task of their conversation in one exchange; each of both passes reads them in order
from a sort that may spill, and holds four costs or one state. Between the passes a turn carries its
policy, the tight edits of all four states in 16 bits. So memory does not grow with a conversation. Its audit
and its hash are sequential by their definition, so one task reads all turns of one conversation.

Order: by turn, null first, then role and text, so equal rows are next to each other. Nulls: a null
role or text counts as one space, so such a text is blank; a null conv_id is a conversation of its
own. Very long texts, repeated rows and an empty table are nothing special. Only conv_id, turn, role
and text are read; other columns, whatever their names, are not carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
ROLES = ("user", "user", "assistant", "user")  # the role, other than system, that may follow each state
AFTER = (2, 2, 3, 2)  # and the state after it
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}  # by initial: state before to state after
END = (0, 2 * INSERT, INSERT, 0)  # what is left to pay after the last turn
FINAL = ("", "II", "I", "")
LETTERS = "DKR"
GONE, BLANK, DUPLICATE, CUT = -1, 1, 2, 3
ORDER = ["conv_id", "turn", "role", "text", "nth"]  # nulls first


def damaged(turns: DataFrame) -> DataFrame:
    """Turns damaged by crc32(`conv_id:turn`) % 20: 0 marks it as not present, 1 empties the text, 2 takes its marks, 3 repeats it, 4 makes it a user's."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), copies.alias("copy")).drop("copy")


def judged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, nth, fault; all turns of a conversation in one partition."""
    plain = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    present = F.col("present") if "present" in turns.columns else F.lit(True)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), plain("role"), plain("text"), present.alias("present")).repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy("turn"))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(~F.col("present"), GONE).when(bare == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT).otherwise(0)
    return rows.withColumn("nth", nth).select("conv_id", "turn", "role", "text", "nth", fault.cast("byte").alias("fault"))


def _same(a, b) -> bool:
    return a == b or (a is None and b is None) or (a != a and b != b)


def step(initial: str, fault: int, to_go: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """Policy of a turn, and the cost to go from each state before it, from those after it."""
    must, late = fault in (BLANK, DUPLICATE), TRUNCATED * (fault == CUT)
    kept = {} if must else KEPT.get(initial, {})
    options = []  # by state: letter and cost
    for s in range(4):
        found = [("D", DELETE + to_go[s])]
        if s in kept:
            found.append(("K", late + to_go[kept[s]]))
        if not must:
            found.append(("R", REROLE + late + to_go[AFTER[s]]))
        options.append(found)
    least = [min(c for _, c in found) for found in options]
    for _ in range(3):  # inserts lead through at most three other states
        least = [min(least[s], INSERT + least[AFTER[s]]) for s in range(4)]
    policy = 0
    for start in range(4):
        s, inserts = start, 0
        while True:
            tight = [x for x, c in options[s] if c == least[s]]
            if "D" in tight or least[s] != INSERT + least[AFTER[s]]:
                break
            s, inserts = AFTER[s], inserts + 1
        policy |= (inserts << 2 | LETTERS.index(tight[0])) << 4 * start
    return policy, tuple(least)


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each turn's policy; turns come last first."""
    known: dict[tuple, tuple[int, tuple[int, ...]]] = {}  # few: costs to go differ by little once their least is taken off
    last, to_go = object(), END
    for batch in batches:
        policies = []
        for conv, role, fault in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("fault").to_pylist(), strict=True):
            if not _same(conv, last):
                last, to_go = conv, END
            if fault == GONE:
                policies.append(0)
                continue
            key = (role[:1] if role[:1] in KEPT else "", fault, to_go)
            if key not in known:
                policy, costs = step(key[0], fault, to_go)
                least = min(costs)
                known[key] = policy, tuple(c - least for c in costs)
            policy, to_go = known[key]
            policies.append(policy)
        yield batch.append_column("policy", pa.array(policies, pa.int32()))


def _edits(policy: int, state: int) -> tuple[int, str]:
    code = policy >> 4 * state & 15
    return code >> 2, LETTERS[code & 3]


def _planned(turns: DataFrame) -> DataFrame:
    """Turns in order, each with its policy."""
    rows = judged(turns).sortWithinPartitions(*ORDER, ascending=False)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_backward, f"{fields}, policy int").sortWithinPartitions(*ORDER)


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, place, edit, turn, role, text: the turns of the repaired conversations in order; inserted ones have no turn. Deleted ones stay as rows of edit D without a place."""
    kind = dict(turns.dtypes)["conv_id"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, place, kind_of = object(), 0, 0, None
        out: list[tuple] = []

        def add(edit: str, turn: int | None, role: str, text: str) -> None:
            nonlocal place
            place += edit != "D"
            out.append((last, None if edit == "D" else place - 1, edit, turn, role, text))

        def insert(n: int) -> None:
            nonlocal state
            for _ in range(n):
                add("I", None, ROLES[state], "")
                state = AFTER[state]

        def flushed() -> pa.RecordBatch:
            columns = [[r[i] for r in out] for i in range(6)]
            out.clear()
            types = [kind_of, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "place", "edit", "turn", "role", "text"])

        for batch in batches:
            kind_of = batch.column("conv_id").type
            for conv, turn, role, text, fault, policy in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "policy")], strict=True):
                if not _same(conv, last):
                    insert(len(FINAL[state]))
                    last, state, place = conv, 0, 0
                if fault == GONE:
                    continue
                inserts, letter = _edits(policy, state)
                insert(inserts)
                if letter == "R":
                    role = ROLES[state]
                add(letter, turn, role, text)
                if letter == "K":
                    state = KEPT[role[:1]][state]
                elif letter == "R":
                    state = AFTER[state]
            yield flushed()
        if kind_of is not None:
            insert(len(FINAL[state]))
            yield flushed()

    return _planned(turns).mapInArrow(walk, f"conv_id {kind}, place long, edit string, turn long, role string, text string")


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Tally:
    """What the report says of one conversation, turn by turn."""

    def __init__(self, conv):
        self.conv, self.state, self.audit, self.hash, self.empty = conv, 0, [], hashlib.sha256(), True
        self.faults, self.illegal, self.cost, self.before = [0, 0, 0, 0], 0, 0, None
        self.first, self.last, self.distinct = None, None, 0

    def put(self, role: bytes, text: bytes) -> None:
        self.hash.update(role + b":" + text if self.empty else b"\n" + role + b":" + text)
        self.empty = False

    def insert(self, n: int) -> None:
        self.cost += INSERT * n
        self.audit.append("I" * n)
        for _ in range(n):
            self.put(ROLES[self.state].encode(), b"")
            self.state = AFTER[self.state]

    def turn(self, turn: int | None, role: str, text: bytes, fault: int, policy: int) -> None:
        initial = role[:1]
        self.faults[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if turn is not None and turn != self.last:
            self.first, self.last, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1
        inserts, letter = _edits(policy, self.state)
        self.insert(inserts)
        self.audit.append(letter)
        if letter == "D":
            self.cost += DELETE
            return
        self.cost += TRUNCATED * (fault == CUT) + REROLE * (letter == "R")
        self.put(role.encode() if letter == "K" else ROLES[self.state].encode(), text)
        self.state = KEPT[initial][self.state] if letter == "K" else AFTER[self.state]

    def row(self) -> tuple:
        self.insert(len(FINAL[self.state]))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def repair_report(turns: DataFrame) -> DataFrame:
    """A row for each conv_id: gaps, faults by kind, illegal neighbours, cost and initials of the edits, hash of the repaired turns.

    Rows whose column `present`, if there is one, is false count for nothing but their conv_id.
    """
    kind = dict(turns.dtypes)["conv_id"]
    names = ["conv_id", *(c.split()[0] for c in REPORT.split(", "))]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind_of = None, None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            types = [kind_of, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            kind_of, rows = batch.column("conv_id").type, []
            text = batch.column("text").cast(pa.binary()).to_pylist()
            for conv, turn, role, body, fault, policy in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role")], text, *[batch.column(c).to_pylist() for c in ("fault", "policy")], strict=True):
                if now is None or not _same(conv, now.conv):
                    if now is not None:
                        rows.append(now.row())
                    now = _Tally(conv)
                if fault != GONE:
                    now.turn(turn, role, body, fault, policy)
            yield made(rows)
        if now is not None:
            yield made([now.row()])

    return _planned(turns).mapInArrow(walk, f"conv_id {kind}, {REPORT}")
