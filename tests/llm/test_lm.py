"""Language-model scores against a plain count of words and pairs."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pairlens.llm import lm
from pairlens.llm.lm import from_planes, learn_weights, lm_scores, packed, planes, squeezed, unpacked, unsqueezed
from pairlens.llm.queries import QUERIES

END = None


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


def plain(rows):
    """doc_id: the row of the result, by the definition."""
    code = lambda i: zlib.crc32(("" if i is None else str(i)).encode())
    docs = [(i, tokens(t), code(i) % 7 == 2, zlib.crc32((t or "").encode()) % lm.TUNE_ONE_IN == 0) for i, t in rows]
    pairs_of = lambda ws: list(zip(["<s>", *ws], ws, strict=False))
    words, pairs, w_rest, p_rest = Counter(), Counter(), Counter(), Counter()
    for _, ws, held, tune in docs:
        if not held:
            words.update(ws)
            pairs.update(pairs_of(ws))
            if not tune:
                w_rest.update(ws)
                p_rest.update(pairs_of(ws))
    n, v, rest = sum(words.values()), len(words), sum(w_rest.values())
    context = lambda c, w: c[END] if w == "<s>" else c[w]
    rounded = lambda p: 0.0 if p == 0 else 2 ** -((math.floor(-math.log2(p) * lm.STEPS) + 0.5) / lm.STEPS)
    seen = Counter()
    for _, ws, held, tune in docs:
        if not held and tune:
            for a, b in pairs_of(ws):
                c = context(w_rest, a)
                seen[c.bit_length(), rounded(p_rest[a, b] / max(c, 1)), rounded(w_rest[b] / max(rest, 1))] += 1
    keys = sorted(seen)
    at = lambda k: np.array([x[k] for x in keys])
    weights = learn_weights(at(0).astype(int), at(1), at(2), 1 / (v + 1), np.array([float(seen[k]) for k in keys]))
    out = []
    for i, ws, held, _ in docs:
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in ws)
        score = 0.0
        for a, b in pairs_of(ws):
            c = context(words, a)
            w = weights[c.bit_length()]
            score += math.log10(w[0] * pairs[a, b] / max(c, 1) + w[1] * words[b] / max(n, 1) + w[2] / (v + 1))
        out.append((i, held, len(ws), sum(words[w] > 0 for w in ws), n, base, score))
    return out


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0)
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)
    assert [r[6] for r in got] == pytest.approx([r[6] for r in want], rel=1e-6)


def test_query_equals_plain_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op8_lm"](spark, sf).collect()
    same(got, plain([(r.doc_id, r.text) for r in docs.collect()]))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # on texts it has not seen


def test_many_chunks_and_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    want = plain([(r.doc_id, r.text) for r in odd_docs.collect()])
    same(lm_scores(odd_docs).collect(), want)
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 20)
    same(lm_scores(odd_docs.repartition(5)).collect(), want)
    assert lm_scores(no_docs).collect() == []


def test_counts_survive_packing():
    x = np.array([0, 3, 254, 255, 256, 10**12, 1])
    assert unpacked(packed(x), len(x)).tolist() == x.tolist()
    h = np.array([0, 5, 2**40, 2**64 - 1], dtype=np.uint64)
    assert unsqueezed(squeezed(h)).tolist() == h.tolist()
    assert from_planes(planes(x.astype("<u4")), "<u4").tolist() == x.astype("<u4").tolist()


def test_weights_favour_what_predicts():
    bucket = np.array([1, 1, 9, 9])
    p2, p1 = np.array([0.0, 0.0, 0.9, 0.8]), np.array([0.1, 0.2, 0.01, 0.01])
    a = learn_weights(bucket, p2, p1, 1e-6, np.array([500.0, 500, 500, 500]))
    assert a[9, 0] > 0.9 > 0.1 > a[1, 0] and np.allclose(a.sum(axis=1), 1)


def test_rounding_hardly_moves_scores_and_em_converges(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    coarse = {r.doc_id: r.score for r in lm_scores(docs).collect()}
    monkeypatch.setattr(lm, "STEPS", 4096)
    fine = {r.doc_id: r.score for r in lm_scores(docs).collect()}
    assert all(abs(coarse[i] - fine[i]) <= 1e-3 * abs(fine[i]) for i in fine)
    rng = np.random.default_rng(2)
    bucket, p2, p1, n = rng.integers(0, 5, 200), rng.random(200), rng.random(200) / 10, rng.random(200) * 9
    monkeypatch.setattr(lm, "EM_CHANGE", 0.0)
    want = learn_weights(bucket, p2, p1, 1e-4, n)
    monkeypatch.setattr(lm, "EM_CHANGE", 1e-7)
    assert np.abs(learn_weights(bucket, p2, p1, 1e-4, n) - want).max() < 1e-3


def test_ids_do_not_matter_to_the_weights(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for ids in ("CAST(NULL AS long)", "7L"):
        got = lm_scores(docs.selectExpr(f"{ids} AS doc_id", "text")).collect()
        assert sum(r.score for r in got) > sum(r.base_score for r in got)
