"""Shards: every row once, gapless slots, near equal bytes, also where one text fills most of the table."""

import zlib

import pytest

from pairlens.llm.queries import QUERIES
from pairlens.llm.shards import histogram_shards, sharded


def check(rows, docs, shards):
    texts = sorted((d.doc_id is not None, d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs)
    assert sorted((r.doc_id is not None, r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r.size for r in by.get(s, [])) for s in range(shards)]
    mean, longest = sum(sizes) / shards, max(r.size for r in rows)
    assert max(abs(s - mean) for s in sizes) <= longest + 0.003 * mean + 1


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = QUERIES["op4_shards"](spark, sf).collect()
    check(rows, docs, 16)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


@pytest.mark.parametrize("same", [0.0, 0.4, 1.0])
def test_hot_groups(spark, same):
    df = spark.range(20000).selectExpr("id AS doc_id", f"CASE WHEN id % 100 < {int(100 * same)} THEN 'one text' ELSE repeat('x', int(id % 50)) || id END AS text", "1 AS key", "2 AS size", "3 AS place")
    check(histogram_shards(df, 16).collect(), df.collect(), 16)


def test_equal_rows_are_cut(spark):
    df = spark.range(4000).selectExpr("CAST(NULL AS long) AS doc_id", "CAST(NULL AS string) AS text")
    check(histogram_shards(df, 4).collect(), df.collect(), 4)


def test_odd_rows(spark, odd_docs, no_docs):
    check(histogram_shards(odd_docs, 3).collect(), odd_docs.collect(), 3)
    assert histogram_shards(no_docs).collect() == []


def test_whole_rows_are_sharded(odd_docs):
    """The operator's output, written in the order of slots, holds all columns of all rows."""
    out = sharded(odd_docs, 3)
    plain = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert out.select("document.*").columns == odd_docs.columns
    assert plain(out.select("document.*")) == plain(odd_docs)
    assert out.inputFiles()
    check(out.select("document.doc_id", "size", "text_crc32", "shard", "slot").collect(), odd_docs.collect(), 3)
