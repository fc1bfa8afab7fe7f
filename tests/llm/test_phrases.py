"""Phrases: the query against its SQL, other ways against the plain counts."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from pairlens.llm import phrases
from pairlens.llm.oracle import PHRASES_SQL
from pairlens.llm.phrases import collocations, radix_order
from pairlens.llm.queries import op12_phrases


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    result = con.execute(PHRASES_SQL)
    names = [c[0] for c in result.description]
    df = op12_phrases(spark, sf)
    assert df.columns == names
    assert sorted(tuple(r) for r in df.collect()) == sorted(result.fetchall())


def test_radix_order():
    rng = np.random.default_rng(1)
    for high in (1, 50, 2**40):
        hi, lo = rng.integers(0, high, 5000, dtype=np.uint64), rng.integers(0, 2**63, 5000, dtype=np.uint64) % np.uint64(high + 3)
        assert (radix_order([hi, lo]) == np.lexsort((lo, hi))).all()
    assert len(radix_order([np.zeros(0, np.uint64)] * 2)) == 0


def plain(rows, per_lang, least):
    """rows: (lang, text)."""
    f, totals = Counter(), Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            f.update((lang or "und", tuple(words[i : i + n])) for n in range(1, 5) for i in range(len(words) - n + 1))
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in good.items():
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        around = [b for (other, q), b in good.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * b >= 80 * a for b in around):
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:per_lang])}


@pytest.mark.parametrize("words", [10**6, 0])
def test_many_ranges_and_joined_dictionary(spark, monkeypatch, words):
    """Several runs, many ranges, with the dictionary broadcast and joined; odd separators, letters and a common passage."""
    for name, value in {"RANGE_KEYS": 100, "DICTIONARY_WORDS": words, "CHUNK_BYTES": 2000}.items():
        monkeypatch.setattr(phrases, name, value)
    rng = random.Random(3)
    vocabulary = ["a", "B", "c", "Ü", "de", "x y", "f", "g", "naïve"]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\x0c", ","]) for _ in range(rng.randrange(60)))) for _ in range(60)]
    rows += [("en", "once upon a time there was, and so on")] * 40 + [("en", None), (None, ""), ("fr", "one two " * 4000)]
    df = spark.createDataFrame([(x, y, 1, "z") for x, y in rows], "lang string, text string, key int, word string").repartition(5)
    got = {tuple(r) for r in collocations(df, 40, 6).collect()}
    assert got == plain(rows, 40, 6)
    assert any("once upon a time" == r[2] for r in got)


def test_odd_and_empty(spark, odd_docs, no_docs):
    got = collocations(odd_docs.withColumn("lang", odd_docs["shard"].cast("string").substr(2, 1)), least=2)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got.count() > 0
    assert collocations(no_docs).collect() == []
