"""Repair of conversations: the query against its SQL, small ones against all sequences of edits."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from pairlens.llm.conversations import damaged, repair_report, repaired
from pairlens.llm.oracle import REPAIR_SQL
from pairlens.llm.queries import op13_conversations

TURNS = "conv_id long, turn long, role string, text string"


def as_sql(path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    return con.execute(REPAIR_SQL)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, scale):
    sf = f"/root/testdata/{scale}"
    result = as_sql(f"{sf}/conversations.parquet")
    names = [c[0] for c in result.description]
    df = op13_conversations(spark, sf)
    assert df.columns == names
    assert sorted(tuple(r) for r in df.collect()) == sorted(result.fetchall())


def test_crc_of_the_damage(spark):
    rows = [(c, t, "user", "Is it. So! x") for c in range(8) for t in range(8)] + [(None, None, "assistant", "Yes."), (1, None, None, None)]
    got = damaged(spark.createDataFrame(rows, TURNS)).collect()
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", " " if text is None else text
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text, kind != 0)
        want += [row] * (1 + (kind == 3))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def plain_repair(rows):
    """Cost, audit and repaired turns, by trying all sequences of edits. rows: (role, text) in order."""
    best = None
    faults = []
    for i, (role, text) in enumerate(rows):
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "dup" if (role, text) in rows[:i] else "cut" if bare[-1] not in ".!?" else "")
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        if sum(inserts) > len(rows) + 1:
            continue
        for letters in itertools.product("DKR", repeat=len(rows)):
            if any(f in ("blank", "dup") and x != "D" for x, f in zip(letters, faults)):
                continue
            slots = []  # audit letter, choices of (role, text)
            for i in range(len(rows) + 1):
                slots += [("I", [("user", ""), ("assistant", "")])] * inserts[i]
                if i < len(rows):
                    role, text = rows[i]
                    slots.append((letters[i], {"D": [None], "K": [(role, text)], "R": [("user", text), ("assistant", text)]}[letters[i]]))
            cost = 3 * sum(inserts) + sum({"D": 4, "K": 0, "R": 3}[x] for x in letters) + 3 * sum(f == "cut" and x != "D" for x, f in zip(letters, faults))
            audit = "".join(x for x, _ in slots)
            if best is not None and (cost, audit) >= best[:2]:
                continue
            for made in itertools.product(*(c for _, c in slots)):
                made = [m for m in made if m]
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in made)):
                    best = (cost, audit, made)
                    break
    return best


def test_cheapest_of_all_edits(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for c in range(60):
        own = [(rng.choice(["system", "user", "assistant", "assistant", "tool"]), rng.choice(["A b.", "Cut off", "Why?", "", "A b."])) for _ in range(rng.randrange(5))]
        rows += [(c, 2 * t, *x) for t, x in enumerate(own)]
        if own:
            want[c] = plain_repair(own)
    df = spark.createDataFrame(rows, TURNS)
    got = {r.conv_id: r for r in repair_report(df).collect()}
    made = {}
    for r in repaired(df).where("edit <> 'D'").orderBy("conv_id", "place").collect():
        made.setdefault(r.conv_id, []).append((r.role, r.text))
    assert set(got) == set(want)
    for c, (cost, audit, turns) in want.items():
        assert (got[c].cost, got[c].audit) == (cost, audit)
        assert got[c].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        assert made.get(c, []) == turns


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, ties of turns, a long text, a long conversation, columns named like results."""
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (1, None, "user", "A."), (1, 2, None, "B."), (1, 2, "user", None), (1, 2, "user", "A."), (1, 2, "assistant", "A."), (1, 2, "assistant", "A.")]
    rows += [(2, 0, "user", "w " * 200000 + "end."), (2, 1, "assistant", " \t\n"), (3, 9, "", ""), (4, -5, "User", "x.\x0b"), (5, 7, "système", "é!"), (5, 8, "user", "ok?  "), (5, 10, "assistant", "…")]
    rows += [(6, t, ("user", "assistant")[t % 2], f"Turn {t % 2500}.") for t in range(5000)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS cost", "'x' AS audit", "2 AS nth", "3 AS fault", "4 AS policy")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = op13_conversations(spark, str(tmp_path)).collect()
    want = as_sql(f"{tmp_path}/conversations.parquet/*.parquet").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert len(got) == 7
    assert repaired(df).columns == ["conv_id", "place", "edit", "turn", "role", "text"]


def test_empty_and_wholly_dropped(spark):
    empty = spark.createDataFrame([], TURNS)
    assert repair_report(damaged(empty)).collect() == [] and repaired(empty).collect() == []
    gone = next((c, t) for c in range(100) for t in range(20) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    (r,) = repair_report(damaged(spark.createDataFrame([(*gone, "user", "Hi.")], TURNS))).collect()
    assert tuple(r) == (gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
