"""Similar texts against all pairs, compared outright."""

import importlib

import numpy as np
import pytest

from pairlens.llm import similar
from pairlens.llm.similar import _set_of, one_of_each, shingles, similar as sets_similar

pipeline = importlib.import_module("corpus_pipeline")


def are_similar(x, y):
    return sets_similar(_set_of(x), _set_of(y))


def plain_kept(rows):
    sets = []
    for i, text in rows:
        words = (text or "").lower().split()
        sets.append((i, {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))}))
    label = {i: i for i, _ in sets}
    pairs = [(i, j) for i, x in sets for j, y in sets if i < j and 10 * len(x & y) >= 8 * len(x | y)]
    for _ in range(len(sets)):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return sorted(set(label.values()))


def test_stage_leaves_no_similar_pair(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES[:2]:
        before = docs.select("doc_id", "text").collect()
        docs = stage(spark, docs, sf).cache()
    want = plain_kept([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in docs.collect()) == want
    assert len(want) < len(before)


@pytest.mark.parametrize("size", [3, 30])
def test_large_groups(spark, monkeypatch, size):
    """A group of near copies, and many texts that share a passage only."""
    monkeypatch.setattr(similar, "GROUP", size)
    copy = [f"c{i}" for i in range(120)]
    rows = [(n, " ".join([*copy[:n], f"x{n}", *copy[n + 1 :]])) for n in range(60)]
    rows += [(100 + n, " ".join([*(f"p{i}" for i in range(60)), *(f"y{n}-{i}" for i in range(60))])) for n in range(60)]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(rows) == [0, *range(100, 160)]


@pytest.mark.parametrize("size", [3, 20, 1024])
def test_chains(spark, monkeypatch, size):
    """Each text is similar to its neighbours only, however large the group that holds them all."""
    monkeypatch.setattr(similar, "GROUP", size)
    monkeypatch.setattr(similar, "FEW", 2)
    rows = [(n, " ".join([f"c{i}" for i in range(8 * n, 8 * n + 120)])) for n in range(50)]
    rows += [(100 + n, " ".join([*(f"p{i}" for i in range(4 * (n % 25), 200)), *(f"y{n}-{i}" for i in range(30))])) for n in range(50)]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(rows)


def test_ring(spark, monkeypatch):
    """A text that is similar to one similar to the pivot, not to the pivot itself, is linked."""
    monkeypatch.setattr(similar, "GROUP", 4)
    monkeypatch.setattr(similar, "FEW", 2)
    copy = [f"c{i}" for i in range(200)]
    rows = [(n, " ".join([*copy[: 195 - n % 2], *(f"x{n}-{i}" for i in range(5))])) for n in range(20)]
    rows += [(50 + n, " ".join([*copy[: 168 - n], *(f"z{i}" for i in range(2 + n))])) for n in range(20)]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(rows)


def test_few_shingles_kept_between_pairs(spark, monkeypatch):
    """Sets that are forgotten and hashed again give the same rows."""
    rows = [(n, " ".join(f"w{(n // 4 * 1000 + i) if i > 2 else n * 10 + i}" for i in range(80))) for n in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(r.doc_id for r in one_of_each(docs).collect())
    monkeypatch.setattr(similar, "HELD", 1)
    assert sorted(r.doc_id for r in one_of_each(docs).collect()) == want == plain_kept(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    got = one_of_each(odd_docs)
    assert got.columns == odd_docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 4, 7, 8, 9, 10, 11]
    assert one_of_each(no_docs).collect() == []


CLASHING = ["node", "fp", "keys", "key", "marks", "norm", "digest", "first", "root", "_lines", "_kept", "_digest", "_row", "_times", "_again", "document"]


def test_columns_of_any_name_stay_as_they_are(spark, odd_docs, sf):
    docs = odd_docs.selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in CLASHING if c not in odd_docs.columns])
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHING if c not in odd_docs.columns), name


def test_one_of_each_group_stays_whatever_its_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (5, b), (None, c), (None, c), (None, a), (7, None), (7, ""), (None, None)]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, got.collect()))) in [sorted(map(str, [(3, a), (5, b), (None, c), (7, x)])) for x in (None, "")]


def test_shingles_are_those_of_the_words():
    words = [f"w{i % 7}".encode() for i in range(30)]
    want = [tuple(words[i : i + 5]) for i in range(26)]
    got = shingles(words).tolist()
    assert len(got) == len(want) and len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))
    assert len(shingles(words[:3])) == 1 and shingles(words[:3])[0] != shingles(words[1:4])[0]
    assert are_similar(" ".join(f"x{i}" for i in range(100)), " ".join(f"x{i}" for i in range(2, 100))) and not are_similar("a b c d e f g", "a b c d x f g")


@pytest.mark.parametrize("size", [20, 100, 300, 1000, 3000, 20000])
def test_estimates_at_any_length(size):
    """Marks tell disjoint sets from sets of the similarity, however many shingles they have."""
    rng = np.random.default_rng(size)
    marks = lambda hashes: np.frombuffer((similar.signature(hashes) & np.uint32(255)).astype(np.uint8).tobytes(), np.uint8)
    for _ in range(10):
        x = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
        apart = similar._estimates(marks(x[:size]), marks(x[size:]))
        assert apart < 0.1
        shift = size // 9  # shares 8 of 10 distinct shingles
        near = similar._estimates(marks(x[:size]), marks(x[shift : shift + size]))
        assert near > similar.DOUBT
