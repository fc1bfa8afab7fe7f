"""Toxicity: FTRL against a step-by-step version, held-out quality, odd rows."""

import math
import random
import zlib

import numpy as np
import pytest

from pairlens.llm import toxicity as tox
from pairlens.llm.queries import op11_toxicity
from pairlens.llm.toxicity import Features, fit, toxicity

LABELS = "doc_id long, quality int, toxic int"


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1


def plain_fit(examples, seed=11):
    """The same learner, a coordinate at a time; the bias is coordinate -1, without penalties."""
    z, n = {}, {}

    def weight(j):
        zj, nj = z.get(j, 0.0), n.get(j, 0.0)
        l1, l2 = (0.0, 0.0) if j == -1 else (tox.L1, tox.L2)
        return 0.0 if abs(zj) <= l1 else -(zj - math.copysign(l1, zj)) / ((tox.BETA + math.sqrt(nj)) / tox.ALPHA + l2)

    rng = np.random.default_rng(seed)
    for _ in range(tox.EPOCHS):
        for i in rng.permutation(len(examples)):
            slots, y = examples[i]
            w = {j: weight(j) for j in [-1, *slots.tolist()]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for j, wj in w.items():
                sigma = (math.sqrt(n.get(j, 0.0) + g * g) - math.sqrt(n.get(j, 0.0))) / tox.ALPHA
                z[j] = z.get(j, 0.0) + g - sigma * wj
                n[j] = n.get(j, 0.0) + g * g
    return {j: weight(j) for j in z if j >= 0 and weight(j)}, weight(-1)


def test_fit_equals_plain_version():
    rng = random.Random(2)
    examples = []
    for _ in range(300):
        y = rng.random() < 0.4
        slots = sorted({rng.randrange(50) for _ in range(8)} | ({60, 61} if y else {62}))
        examples.append((np.array(slots, np.int32), float(y)))
    slots, weights, bias = fit(examples)
    want, want_bias = plain_fit(examples)
    assert sorted(want) == slots.tolist() and bias == pytest.approx(want_bias)
    assert weights.tolist() == pytest.approx([want[j] for j in sorted(want)], rel=1e-5)
    assert set(slots.tolist()) < set(range(63)) and {60, 62} <= set(slots.tolist())  # sparse


def test_features(monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice(["a", "B", "ß", "dd", "e"]) for _ in range(400))
    whole = Features().of(text)
    monkeypatch.setattr(tox, "WORDS_AT_ONCE", 7)
    assert (Features().of(text) == whole).all()
    assert len(Features().of("one")) == 1 and len(Features().of("one two")) == 3 and len(Features().of("one two three")) == 6
    assert len(Features().of(None)) == len(Features().of(" .\n")) == 0
    assert (Features().of("One, two!") == Features().of("one two")).all()


def test_held_out_quality(spark):
    """Texts with an insult that training rows have often are found; texts labelled as harmless are left alone."""
    sf = "/root/testdata/sf0.1"
    df = op11_toxicity(spark, sf)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    labels, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "documents"))
    rows = df.join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    out = [r for r in rows if r.held_out]
    insult = lambda r: any(w in r.text.lower() for w in ("idiot", "moron", "scum", "pathetic", "worthless", "clown"))
    bad = [r.predicted for r in out if r.toxic and insult(r)]
    clean = [r.predicted for r in out if not r.toxic]
    assert len(bad) > 50 and np.mean(bad) > 0.93
    assert len(clean) > 500 and np.mean(clean) < 0.01


def test_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], LABELS)
    got = toxicity(odd_docs, none).collect()
    assert len(got) == odd_docs.count() and all(r.score == 0 and r.predicted == 0 for r in got)
    assert toxicity(no_docs, none).collect() == []
    labels = spark.createDataFrame([(None, 1, 1), (1, 0, None), *[(i, 0, i % 2) for i in range(2, 12)], (4, 1, 0), (11, 1, 1)], LABELS)
    got = toxicity(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    nameless = odd_docs.unionByName(odd_docs.limit(3).withColumn("doc_id", odd_docs["doc_id"] * None))
    assert toxicity(nameless, labels).where("doc_id IS NULL").count() == 3


def test_copies_and_the_bound(spark):
    """A text that a third of all rows hold is one example, and the sample keeps its bounds."""
    docs = spark.createDataFrame([(i, "You are a moron and a clown" if i % 3 == 0 else f"calm words number {i} of many") for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(900)], LABELS)
    every = tox.sample(docs, labels, 3, 1).collect()
    assert len(every) == 1 + sum(i % 3 != 0 and not held(i) for i in range(900))
    assert sum(r.label for r in every) == 1
    assert 20 < tox.sample(docs, labels, 3, 1, rows=100).count() < 120
    assert 5 < tox.sample(docs, labels, 3, 1, size=1000).count() < 60
