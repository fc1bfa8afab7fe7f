"""Mixing: targets by a plain loop, words taken near them, and the knapsack against all subsets."""

import itertools
import re

import numpy as np
import pytest

from pairlens.llm.mixing import fit, knapsack, mix, mixed
from pairlens.llm.queries import QUERIES


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def check(rows, docs):
    docs = {d.doc_id: d for d in docs}
    sizes = {}
    for d in docs.values():
        sizes[d.source] = sizes.get(d.source, 0) + words(d.text)
    target = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        d = docs[r.doc_id]
        assert (r.size, r.source_size) == (words(d.text), sizes[d.source])
        assert abs(r.target - target[d.source]) < 1e-6 * max(1, target[d.source])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[d.source] += r.taken
    return {s: abs(taken[s] - target[s]) for s in sizes}


def test_query_meets_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = QUERIES["op6_mixing"](spark, sf).collect()
    assert len(rows) == len(docs)
    off = check(rows, docs)
    source = {d.doc_id: d.source for d in docs}
    for s in off:  # no further document of the source would fit
        own = [r for r in rows if source[r.doc_id] == s and r.size]
        least = min(r.taken // r.size for r in own)
        assert off[s] < min([r.size for r in own if r.taken // r.size == least and least < 3], default=1) + 1
    again = {r.doc_id: r.taken for r in QUERIES["op6_mixing"](spark, sf).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_odd_rows(spark, odd_docs, no_docs):
    once = odd_docs.dropDuplicates(["doc_id"])
    rows = mix(once).collect()
    check(rows, once.collect())
    got = mixed(once)
    assert got.columns == odd_docs.columns
    count = {}
    for r in got.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {r.doc_id: r.taken // r.size for r in rows if r.taken}
    assert mix(odd_docs).count() == odd_docs.count()
    assert mix(no_docs).collect() == [] and mixed(no_docs).collect() == []


@pytest.mark.parametrize("doc_id", [None, 8])
def test_rows_without_an_id_of_their_own(spark, doc_id):
    rows = [(doc_id, f"x{i % 20} y z", "a") for i in range(30)] + [(i, "d e f", "b") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.source: r.n for r in mixed(docs).groupBy("source").count().withColumnRenamed("count", "n").collect()}
    assert taken == {"a": 85, "b": 34}  # 5 : 2 of 360 words, in texts of three words, never above the target


def test_knapsack_equals_all_subsets():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = sorted(set(rng.integers(1, 30, 4).tolist()))
        counts = rng.integers(1, 4, len(lengths)).tolist()
        budget = int(rng.integers(0, 120))
        best = max(s for take in itertools.product(*[range(c + 1) for c in counts]) if (s := sum(t * n for t, n in zip(take, lengths, strict=True))) <= budget)
        got = knapsack(lengths, counts, budget)
        assert sum(n * k for n, k in got.items()) == best and all(k <= counts[lengths.index(n)] for n, k in got.items())


def test_fit_takes_what_there_is():
    sizes, counts = np.array([0, 3, 7, 50]), np.array([5, 400, 100, 9])
    for target in (0.0, 1.0, 1000.0, 2350.0, 5000.0, 7050.0):
        repeats, take = fit(sizes, counts, target)
        assert ((0 <= take) & (take <= counts)).all()
        assert abs(repeats * (sizes * counts).sum() + (take * sizes).sum() - target) <= 1.5
