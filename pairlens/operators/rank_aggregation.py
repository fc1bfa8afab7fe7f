"""One list out of the lists of several configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def aggregated(top: DataFrame, k: int, by: str = "borda") -> DataFrame:
    """place, lid, rid, n_lists, borda, median_rank of every pair in a list. top: (config, lid, rid, rank), ranks from 1 to k.

    A pair has k + 1 - rank points of each list (borda), and in lists without it the rank k + 1 (median_rank,
    the mean of the two middle ranks where the number of lists is even). Order: points, or median rank and then points;
    then the number of lists, then the keys, the larger first.
    """
    if by not in ("borda", "median"):
        raise ValueError(f"no such rank aggregation: {by}")
    lists = top.select("config").distinct().count()
    ranks = F.sort_array(F.concat(F.collect_list("rank"), F.array_repeat(F.lit(k + 1), F.lit(lists) - F.count("*").cast("int"))))
    pairs = top.select("config", "lid", "rid", F.col("rank").cast("int").alias("rank")).groupBy("lid", "rid").agg(F.count("*").alias("n_lists"), F.sum(F.lit(k + 1) - F.col("rank")).alias("borda"), ranks.alias("ranks"))
    middle = (F.element_at("ranks", (lists + 1) // 2) + F.element_at("ranks", lists // 2 + 1)) / 2 if lists else F.lit(0.0)
    scored = pairs.select("lid", "rid", "n_lists", "borda", middle.alias("median_rank"))
    first = [F.desc("borda")] if by == "borda" else [F.asc("median_rank"), F.desc("borda")]
    # at most k pairs a list, so one task orders them
    order = Window.partitionBy(F.lit(0)).orderBy(*first, F.desc("n_lists"), F.desc("lid"), F.desc("rid"))
    return scored.select(F.row_number().over(order).alias("place"), "lid", "rid", "n_lists", "borda", "median_rank")
