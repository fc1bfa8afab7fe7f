"""Small tables for the corpus operators: nulls, empty and long texts, repeated rows, clashing names."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def doc(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text))


@pytest.fixture
def odd_docs(spark):
    """Null and empty texts, null source and lang, copies, a long text, and extra columns named like results."""
    prose = "The quick brown fox jumps over the lazy dog near the quiet river bank today."
    rows = [
        doc(1, None), doc(2, ""), doc(3, " \n\t "), doc(4, prose), doc(5, prose), doc(6, prose + " Indeed."),
        doc(7, "one", None, None), doc(8, "Wort und Satz über Straße.", "de", "b"), doc(9, " ".join(f"w{i % 97}" for i in range(30000))),
        doc(10, "mail bob@example.com or +1 415 555 0199 now", "en", None), doc(11, "ÀÉ 123 ©", "fr", "b"), doc(11, "ÀÉ 123 ©", "fr", "b"),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 AS shard", "'x' AS key", "2L AS size", "true AS kept", "5 AS rank", "'f' AS fp")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
