"""Parts of similarity joins of token sets: Jaccard similarity, document frequencies, order and bounds of tokens, lengths, counts by field.

The joins themselves are in bounded.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.model import CandidateSet

SLACK = 1e-9


def jaccard(shared: Column, left: Column, right: Column) -> Column:
    """0 where both are empty."""
    union = left + right - shared
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / F.nullif(union, F.lit(0)))


def without(pairs: DataFrame, candidates: DataFrame | None) -> DataFrame:
    """Pairs (lid, rid) that are not candidates."""
    return pairs if candidates is None else pairs.join(candidates.select("lid", "rid"), ["lid", "rid"], "left_anti")


def with_blocks(left: DataFrame, right: DataFrame, candidates: CandidateSet | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Both sides with their blocks, where the candidates are blocks and name each id once; else the sides and the pairs."""
    if candidates is None or candidates.blocks is None:
        return left, right, None if candidates is None else candidates.pairs()
    of = [b.groupBy("id").agg(F.min("block").alias("block"), F.max("block").alias("most"), F.count("block").alias("n"), F.count("*").alias("rows")) for b in candidates.blocks]
    if any(not x.where("n NOT IN (0, rows) OR block <> most").isEmpty() for x in of):
        return left, right, candidates.pairs()
    blocks = [x.select("id", "block") for x in of]
    return left.join(blocks[0], "id", "left"), right.join(blocks[1], "id", "left"), None


def document_frequency(left: DataFrame, right: DataFrame) -> DataFrame:
    """t, l_df, r_df, df: in how many sets of either side a token is."""
    sides = left.select(F.explode("tokens").alias("t"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select(F.explode("tokens").alias("t"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    return sides.groupBy("t").agg(F.sum("l").alias("l_df"), F.sum("r").alias("r_df")).withColumn("df", F.col("l_df") + F.col("r_df"))


def rare_first(docs: DataFrame, frequency: DataFrame) -> DataFrame:
    """id, tokens with the rarest first: a total order, the same for both sides."""
    rows = docs.select("id", F.explode("tokens").alias("t")).join(frequency.select("t", "df"), "t")
    ordered = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("x")).select("id", F.col("x.t").alias("tokens"))
    return ordered.join(docs.drop("tokens"), "id") if len(docs.columns) > 2 else ordered


def bounds(docs: DataFrame) -> DataFrame:
    """id, place, t, bound: no set that shares its first token here or later is more similar than bound."""
    n = F.size("tokens")
    return docs.select("id", n.alias("n"), F.posexplode("tokens").alias("place", "t")).select("id", "place", "t", (1 - F.col("place") / F.col("n")).alias("bound"))


# Token multisets, with the field of each token


def pair_field_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """lid, rid, lf, rf, cnt: equal numbered tokens of two rows by their fields. left, right: (id, f, t)."""
    a = left.select(F.col("id").alias("lid"), F.col("f").alias("lf"), "t")
    b = right.select(F.col("id").alias("rid"), F.col("f").alias("rf"), "t")
    return a.join(b, "t").groupBy("lid", "rid", "lf", "rf").agg(F.count("*").alias("cnt"))


def _kept(field: str, config: tuple[int, ...]) -> Column:
    return F.col(field).isin(*config)


def record_lengths(tokens: DataFrame, ids: DataFrame, configs: list[tuple[int, ...]]) -> DataFrame:
    """id, n0, n1, ...: tokens of each record in each configuration, 0 where none are left."""
    counts = tokens.groupBy("id").agg(*[F.count_if(_kept("f", c)).alias(f"n{i}") for i, c in enumerate(configs)])
    return ids.join(counts, "id", "left").select("id", *[F.coalesce(f"n{i}", F.lit(0)).alias(f"n{i}") for i in range(len(configs))])


def label_of(config: tuple[int, ...]) -> str:
    return "_".join(map(str, config))
