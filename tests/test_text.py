"""Text of fields, k-grams and tokens: the cases that are easy to get wrong."""

import datetime

from pairlens.functions.text import as_text, joined, kgram_docs, numbered_tokens, token_sets


def one(spark, rows, schema, columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[as_text(c, df.schema[c].dataType).alias(c) for c in columns]).collect()]


def test_numbers_round_half_to_even(spark):
    values = [29.5, 32.5, 27.5, 2.5, float("nan"), None, 1e300]
    got = [r[0] for r in one(spark, [(v,) for v in values], "x double", ["x"])]
    assert got[:6] == ["30", "32", "28", "2", "", ""] and got[6]


def test_other_types(spark):
    row = (5, True, datetime.date(2020, 1, 2), None, "t")
    assert one(spark, [row], "a int, b boolean, c date, d long, e string", list("abcde")) == [("5", "true", "2020-01-02", "", "t")]


def test_null_leaves_its_space(spark):
    df = spark.createDataFrame([(None, "X")], "a string, b string")
    assert df.select(joined(df, ["a", "b"])).first()[0] == " x"


def test_kgrams(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "ABCABC"), (3, None), (4, "äöü")], "id long, s string")
    got = {r.id: sorted(r.tokens) for r in kgram_docs(df, "id", ["s"]).collect()}
    assert got == {1: [], 2: ["abc", "bca", "cab"], 3: [], 4: ["äöü"]}


def test_token_sets_keep_the_empty_token(spark):
    df = spark.createDataFrame([(1, "a  b", "A"), (2, None, "c\td"), (3, None, None)], "id long, s string, t string")
    got = {r.id: sorted(r.tokens) for r in token_sets(df, "id", ["s", "t"]).collect()}
    assert got == {1: ["", "a", "b"], 2: ["c\td"], 3: []}


def test_numbering_spans_fields_and_has_no_collisions(spark):
    df = spark.createDataFrame([(1, "a  a a_1", "A b"), (2, None, "")], "id long, s string, t string")
    got = sorted((r.id, r.f, r.t) for r in numbered_tokens(df, "id", ["s", "t"]).collect())
    assert got == [(1, 0, "a 0"), (1, 0, "a 1"), (1, 0, "a_1 0"), (1, 1, "a 2"), (1, 1, "b 0")]
