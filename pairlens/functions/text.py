"""Text of fields, k-grams and tokens, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_text(name: str, kind: T.DataType) -> Column:
    """A field as text: null and NaN are empty, fractions are rounded half to even."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return F.coalesce(c, F.lit(""))
    if isinstance(kind, T.FloatType | T.DoubleType):
        whole = F.bround(c.cast("double"), 0).try_cast("decimal(38,0)").cast("string")
        return F.when(c.isNull() | F.isnan(c), F.lit("")).otherwise(F.coalesce(whole, c.cast("string")))
    if isinstance(kind, T.DecimalType):
        return F.coalesce(F.bround(c, 0).cast("decimal(38,0)").cast("string"), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def texts(df: DataFrame, columns: list[str]) -> list[Column]:
    return [as_text(c, df.schema[c].dataType) for c in columns]


def joined(df: DataFrame, columns: list[str]) -> Column:
    """All fields in lower case with a space between; a null field leaves its space."""
    return F.lower(F.concat_ws(" ", *texts(df, columns)))


def kgrams(text: Column, k: int = 3) -> Column:
    """The distinct substrings of k code points; none for shorter texts."""
    starts = F.sequence(F.lit(1), F.length(text) - (k - 1))
    return F.when(F.length(text) >= k, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(k))))).otherwise(F.array().cast("array<string>"))


def keyed_texts(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """id, text: all fields of each row."""
    return df.select(F.col(key).alias("id"), joined(df, columns).alias("text"))


def kgram_docs(df: DataFrame, key: str, columns: list[str], k: int = 3) -> DataFrame:
    """id, tokens: the k-grams of each row's fields."""
    return keyed_texts(df, key, columns).select("id", kgrams(F.col("text"), k).alias("tokens"))


def token_sets(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """id, tokens: the distinct tokens of each row's fields, split at single spaces; null fields give none, double spaces the empty token."""
    parts = [F.when(F.col(f"`{c}`").isNotNull(), F.split(F.lower(t), " ")).otherwise(F.array().cast("array<string>")) for c, t in zip(columns, texts(df, columns), strict=True)]
    return df.select(F.col(key).alias("id"), F.array_distinct(F.concat(*parts)).alias("tokens"))


def numbered_tokens(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """id, f, t: every token of every field; t is the token and how often it came before in the row, over all fields.

    Tokens are numbered once, over all fields; a configuration without a field drops its tokens
    and leaves the numbers of the others. A space parts token and number: no token holds one.
    """
    rows = df.select(F.col(key).alias("id"), *[t.alias(f"x{f}") for f, t in enumerate(texts(df, columns))])
    words_of = lambda f: F.transform(F.split(F.lower(f"x{f}"), " "), lambda w: F.struct(F.lit(f).alias("f"), w.alias("w")))
    places = range(len(columns))
    # rows move once, as texts: all that groups by id, or by id and word, finds its rows in one place
    words = rows.repartition("id").select("id", F.explode(F.filter(F.concat(*map(words_of, places)), lambda x: x["w"] != "")).alias("x")).select("id", "x.*")
    counted = words.groupBy("id", "w").agg(*[F.count_if(F.col("f") == f).cast("int").alias(f"n{f}") for f in places])
    # the numbers of a field follow those of the fields before it
    ends = [reduce(Column.__add__, [F.col(f"n{g}") for g in range(f + 1)]) for f in places]
    runs = [F.struct(F.lit(f).alias("f"), (ends[f] - F.col(f"n{f}")).alias("first"), (ends[f] - 1).alias("last")) for f in places]
    numbers = counted.select("id", "w", F.inline(F.array(*runs))).where("first <= last").select("id", "f", "w", F.explode(F.sequence("first", "last")).alias("i"))
    return numbers.select("id", "f", F.concat("w", F.lit(" "), F.col("i").cast("string")).alias("t"))
