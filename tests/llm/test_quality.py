"""Quality counts against a plain count, and the verdict on texts of known quality."""

import re

import duckdb

from pairlens.llm.quality import cleaned, quality_report
from pairlens.llm.queries import ORACLE_SQL, QUERIES

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = SPLIT.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def same(docs, got):
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, r.text)
    for r in got:
        assert tuple(r)[1:7] == plain(texts[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)


def test_query_equals_plain_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op7_quality"](spark, sf).collect()
    assert len(got) == docs.count()
    same(docs, got)


def by_sql(path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    return sorted(con.execute(ORACLE_SQL["op7_quality"]).fetchall())


def test_query_equals_sql(spark, sf):
    assert sorted(map(tuple, QUERIES["op7_quality"](spark, sf).collect())) == by_sql(f"{sf}/documents.parquet")


def test_odd_rows_equal_sql(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        docs.write.parquet(str(tmp_path / name))
        assert sorted(map(tuple, quality_report(docs).collect())) == by_sql(f"{tmp_path}/{name}/*.parquet")


def test_odd_rows(spark, odd_docs, no_docs):
    got = quality_report(odd_docs).collect()
    assert len(got) == odd_docs.count()
    same(odd_docs, got)
    assert quality_report(no_docs).collect() == []


PROSE = "This is a sentence of plain prose that nobody would object to, with a full stop at its end."


def test_verdicts(spark):
    rows = [
        (1, f"{PROSE}\nAnother line follows it, about something else, and ends as lines should."),
        (2, "\n".join(f"Home | About | Contact | Page {i} | Site map" for i in range(9))),
        (3, f"{PROSE}\nAll rights reserved.\nHome"),
        (4, " ".join(f"w{i}###" for i in range(40)) + "."),
        (5, f"{PROSE} {PROSE}"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) + 0L AS n_chars", "1 AS size", "2 AS _lines")
    assert {r.doc_id: r.kept for r in quality_report(df).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    left = {r.doc_id: r for r in cleaned(df).collect()}
    assert set(left) == {1, 3} and left[3].text == PROSE and left[3].n_chars == len(PROSE)
    assert left[1].text == rows[0][1] and cleaned(df).columns == df.columns


def test_a_long_line_needs_no_mark_at_its_end(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long), (2, f"{long}\nA short line without its mark"), (3, "یہ ایک مکمل جملہ ہے جو دس سے زیادہ الفاظ رکھتا ہے۔"), (4, "これは文です。」 これも文です。」 " * 6)]
    left = {r.doc_id: r.text for r in cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left[1] == left[2] == long and set(left) >= {1, 2, 3}
