"""Packing: every token once, no overlap, permitted lengths, and bins downsized to their contents."""

import re

import numpy as np

from pairlens.llm.packing import LENGTHS, pack, plan
from pairlens.llm.queries import QUERIES


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(rows, docs, lengths=LENGTHS):
    want = {}
    for d in docs:
        want.setdefault(d.doc_id, []).append(words(d.text))
    got, bins = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
        if r.length == 0:
            assert r.bin_id is None and r.piece == 0
        else:
            assert r.start == r.piece * lengths[-1]
            bins.setdefault(r.bin_id, []).append(r)
    assert set(got) == set(want)
    for i, pieces in got.items():
        assert sum(r.length for r in pieces) == sum(want[i])
        if len(want[i]) == 1:
            assert [r.piece for r in sorted(pieces, key=lambda r: r.piece)] == list(range(len(pieces)))
    for own in bins.values():
        own.sort(key=lambda r: r.bin_start)
        ends = np.cumsum([r.length for r in own])
        assert [r.bin_start for r in own] == [0, *ends[:-1]]
        assert {r.bin_used for r in own} == {ends[-1]} and {r.bin_size for r in own} == {min(n for n in lengths if n >= ends[-1])}
    return sum(b[0].bin_size for b in bins.values()), sum(b[0].bin_used for b in bins.values())


def test_query_packs_tightly(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    size, used = check(QUERIES["op5_packing"](spark, sf).collect(), docs)
    assert used == sum(words(d.text) for d in docs) and used > 0.95 * size


def test_odd_rows(spark, odd_docs, no_docs):
    check(pack(odd_docs).collect(), odd_docs.collect())
    check(pack(odd_docs, (8, 16)).collect(), odd_docs.collect(), (8, 16))
    assert pack(no_docs).collect() == []


def test_plans_are_whole():
    rng = np.random.default_rng(4)
    for _ in range(50):
        counts = {int(n): int(rng.integers(1, 50)) for n in rng.integers(1, 64, 12)}
        placements, sequences = plan(counts, (16, 32, 64))
        placed = {}
        for length, _, pieces, *_ in placements:
            placed[length] = placed.get(length, 0) + pieces
        assert placed == counts
        assert sum((b - a) * used for a, b, _, used in sequences) == sum(n * c for n, c in counts.items())
        assert all(used <= size for _, _, size, used in sequences)
