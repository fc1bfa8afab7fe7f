"""The conditional random field: accuracy on held-out documents, code-switched text, and forward-backward against all paths."""

import itertools
import zlib

import numpy as np
import pytest

from pairlens.llm import langid
from pairlens.llm.langid import UNKNOWN, fit, grams, identified, label_words, posteriors, words
from pairlens.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op3_language"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang is not None and docs[r.doc_id].text]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.95


@pytest.fixture(scope="module")
def model(spark, sf):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400").collect()
    return fit([r.text[:1500] for r in rows], [r.lang for r in rows]), {r.lang: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id >= 400 and n_chars > 800").collect()}


def test_code_switching(model):
    crf, texts = model
    mixed = words(texts["en"])[:30] + words(texts["de"])[:30]
    p, _ = label_words(crf, [mixed])
    said = [crf.langs[k] for k in p.argmax(axis=1)]
    assert np.mean([a == b for a, b in zip(said, ["en"] * 30 + ["de"] * 30, strict=True)]) > 0.85


def test_rerun_agrees():
    rows = ["the cat sat on the mat", "der hund lief in den wald"] * 20, ["en", "de"] * 20
    a, b = fit(*rows), fit(*rows)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.moves, b.moves)


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(1)
    lengths, size = np.array([4, 1, 3]), 3
    e, moves, first = rng.normal(size=(8, size)), rng.normal(size=(size, size)), rng.normal(size=size)
    want = []
    for begin, n in zip((0, 4, 5), lengths, strict=True):
        p = np.zeros((n, size))
        for path in itertools.product(range(size), repeat=int(n)):
            s = first[path[0]] + sum(e[begin + t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path))
            for t, k in enumerate(path):
                p[t, k] += np.exp(s)
        want.append(p / p.sum(axis=1, keepdims=True))
    assert np.allclose(posteriors(e, moves, first, lengths), np.concatenate(want))


def test_grams_know_borders():
    one, _ = grams(["ab"])
    two, begin = grams(["xy", "ab"])
    assert begin.tolist() == [0, 3]
    assert one[:, :3].tolist() == two[:, 3:].tolist()
    assert grams(["ab"])[0].tolist() != grams(["ba"])[0].tolist()


def test_odd_rows(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in identified(odd_docs).collect()}
    assert {i for i, r in got.items() if r.lang_pred == UNKNOWN} == {1, 2, 3}
    assert identified(no_docs).collect() == []
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in identified(unlabelled).collect()] == [(UNKNOWN, 0.0)]


def test_words_are_letters_with_their_marks():
    assert words("½ ² ② 12 _ !") == [] and words("किताब Straße x1y") == ["किताब", "straße", "x", "y"]


def test_samples_do_not_hang_on_ids(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.text: r.lang for r in docs.where("lang IS NOT NULL AND text IS NOT NULL").collect()}
    seen = []
    monkeypatch.setattr(langid, "fit", lambda texts, langs, seed=13: seen.append(len(texts)) or fit(texts, langs, seed))
    for ids in ("CAST(NULL AS long)", "4L"):
        learned_from = docs.selectExpr(f"{ids} AS doc_id", "text", "lang")
        model = langid.learned(learned_from, 4, 2, rows=200)
        assert 100 < seen[-1] <= 200 and len(model.langs) == len(set(truth.values()))
        texts = [t for t in list(truth)[:300] if words(t)]
        names, _ = langid.predict(model, [words(t) for t in texts])
        assert np.mean([a == truth[t] for a, t in zip(names, texts, strict=True)]) > 0.95
