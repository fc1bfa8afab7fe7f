"""A blocker to debug: equality of one attribute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.model import CandidateSet, KeyedTable

TILE = {"l": 64, "r": 256}  # keys of one block in a list, about: pairs are formed from a list of either side
CELL = 16_384  # keys of one block and side that one task pairs, about


def block_equal(left: KeyedTable, right: KeyedTable, left_column: str, right_column: str) -> CandidateSet:
    """Pairs of rows with equal values; null equals nothing."""
    a = left.df.selectExpr(f"`{left.key}` AS id", f"`{left_column}` AS block")
    b = right.df.selectExpr(f"`{right.key}` AS id", f"`{right_column}` AS block")
    return CandidateSet(block_pairs(a, b), "lid", "rid", (a, b))


def block_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """lid, rid of every two rows of equal blocks. left, right: (id, block).

    Few blocks make many pairs: keys are gathered in lists, lists of a block are dealt to cells, and each two lists of a
    cell are a tile of pairs. Inside a tile keys come again and again, so written pairs take a tenth of a byte or two each.
    """
    count = lambda df, s: df.groupBy("block").agg(F.ceil(F.count("*") / TILE[s]).cast("int").alias(f"{s}parts"))
    parts = count(left, "l").join(count(right, "r"), "block")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["block", "lcell", "rcell"]

    def cells(df: DataFrame, own: str, other: str) -> DataFrame:
        placed = df.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col(f"{own}parts")))
        lists = placed.groupBy("block", "part", f"{other}parts").agg(F.collect_list("id").alias(f"{own}ids"))
        others = F.sequence(F.lit(0), F.floor((F.col(f"{other}parts") - 1) * TILE[other] / CELL).cast("int"))
        own_cell = F.floor(F.col("part") * TILE[own] / CELL).cast("int").alias(f"{own}cell")
        # a number of tasks: few bytes are many pairs here, so small partitions are not to be merged
        return lists.select("block", own_cell, F.explode(others).alias(f"{other}cell"), f"{own}ids").repartition(tasks, *by)

    tiles = cells(right, "r", "l").join(cells(left, "l", "r"), by)
    return tiles.select(F.explode("lids").alias("lid"), "rids").select("lid", F.explode("rids").alias("rid"))
