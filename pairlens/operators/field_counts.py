"""Tokens that pairs of rows share, by field, added up over all pairs without forming them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators.bounded import dealt
from pairlens.sources.shared import Written

WHOLE = "decimal(19,0)"  # of a key: sums over pairs may pass 64 bits on the way


def _classes(tokens: DataFrame, written: Written) -> DataFrame:
    """f, cls, tokens, n, ids: the distinct sets of tokens of a field; how many rows have one, and the sum of their keys."""
    sets = tokens.groupBy("id", "f").agg(F.sort_array(F.collect_list("t")).alias("tokens"))
    ids = F.sum(F.col("id").cast(WHOLE)).alias("ids")
    return written.table(sets.groupBy("f", "tokens").agg(F.min("id").alias("cls"), F.count("*").alias("n"), ids))


def field_count_totals(left: DataFrame, right: DataFrame) -> DataFrame:
    """lf, rf, cnt, n_pairs, sum_lid, sum_rid: pairs of rows that share cnt numbered tokens of field lf with field rf, and the sums of their keys. left, right: (id, f, t).

    What two rows share of two fields depends on the sets of these fields alone: equal sets of a field are one, and sets
    meet once for all pairs of rows that have them.
    """
    written = Written(left.sparkSession)
    a, b = _classes(left, written), _classes(right, written)

    def side(classes: DataFrame, s: str, *columns) -> DataFrame:
        return classes.select(F.struct("f", "cls").alias(f"{s}cls"), *columns)

    events = [side(c, s, F.lit("").alias("config"), F.explode("tokens").alias("t")) for c, s in ((a, "l"), (b, "r"))]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt(*events, tasks).groupBy("lcls", "rcls").agg(F.count("*").alias("cnt"))
    for classes, s in ((a, "l"), (b, "r")):
        met = met.join(side(classes, s, F.col("n").alias(f"{s}n"), F.col("ids").alias(f"{s}ids")), f"{s}cls")
    summed = lambda ids, n: F.sum(F.col(ids) * F.col(n)).cast("long")
    totals = [F.sum(F.col("ln") * F.col("rn")).alias("n_pairs"), summed("lids", "rn").alias("sum_lid"), summed("rids", "ln").alias("sum_rid")]
    return met.groupBy(F.col("lcls.f").alias("lf"), F.col("rcls.f").alias("rf"), "cnt").agg(*totals)
