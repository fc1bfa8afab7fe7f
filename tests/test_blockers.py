"""Pairs of equal blocks: all of them, each once, in tiles that are small when written."""

import itertools
from collections import Counter
from pathlib import Path

import pytest

from pairlens.model import CandidateSet, KeyedTable
from pairlens.operators import blockers, simjoin
from pairlens.operators.blockers import block_equal, block_pairs


def table(spark, rows, kind="string"):
    return KeyedTable(spark.createDataFrame(rows, f"key long, `a b` {kind}").repartition(3), "key")


@pytest.mark.parametrize("tile,cell", [(3, 5), (1, 1), (256, 16_384)])
def test_every_pair_once(spark, monkeypatch, tile, cell):
    monkeypatch.setattr(blockers, "TILE", {"l": tile, "r": 2 * tile})
    monkeypatch.setattr(blockers, "CELL", cell)
    left = [(i, "hot" if i % 3 else f"b{i % 8}" if i % 5 else None) for i in range(70)]
    right = [(i, "hot" if i % 2 else f"b{i % 9}" if i % 7 else None) for i in range(50)]
    kept = block_equal(table(spark, left), table(spark, right), "a b", "a b")
    got = Counter((r.lid, r.rid) for r in kept.pairs().collect())
    assert got == Counter((i, j) for (i, a), (j, b) in itertools.product(left, right) if a is not None and a == b)
    assert len(got) > 1000
    assert block_equal(table(spark, left), table(spark, []), "a b", "a b").pairs().count() == 0


def test_few_blocks_are_small_when_written(spark, tmp_path):
    """One block of 300 x 30 000: a sort-merge join of its rows wrote 1.9 bytes a pair."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = (KeyedTable(spark.range(n).selectExpr("id AS key", "1 AS b"), "key") for n in (300, 30_000))
        block_equal(left, right, "b", "b").pairs().write.parquet(f"{tmp_path}/pairs")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    n = 9_000_000
    got = spark.read.parquet(f"{tmp_path}/pairs").selectExpr("count(*)", "sum(lid)", "sum(rid)", "sum(lid * rid)").first()
    assert tuple(got) == (n, 30_000 * sum(range(300)), 300 * sum(range(30_000)), sum(range(300)) * sum(range(30_000)))
    assert sum(p.stat().st_size for p in Path(f"{tmp_path}/pairs").glob("*.parquet")) < 0.5 * n


@pytest.mark.parametrize("rows,one", [([(1, "x"), (1, "x"), (2, None), (2, None)], True), ([(1, "x"), (1, "y")], False), ([(1, "x"), (1, None)], False)])
def test_blocks_where_each_key_has_one(spark, rows, one):
    a = spark.createDataFrame(rows, "id long, block string")
    docs = spark.createDataFrame([(1, "d"), (2, "e"), (3, "f")], "id long, doc string")
    left, right, pairs = simjoin.with_blocks(docs, docs, CandidateSet(block_pairs(a, a), "lid", "rid", (a, a)))
    assert (pairs is None) == one
    if one:
        assert sorted(map(tuple, left.collect()), key=str) == [(1, "d", "x"), (2, "e", None), (3, "f", None)]
