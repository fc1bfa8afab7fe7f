"""Row numbers of a table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.sources.shared import Written

PLACE = (1 << 33) - 1  # bits of monotonically_increasing_id that count rows of a partition


def numbered_rows(df: DataFrame, order: list, name: str = "row", first: int = 1, written: Written | None = None) -> DataFrame:
    """df and the number of each row in an order, which is to be total.

    Rows are sorted in ranges; a row's number is its place in its range and the number of rows in the ranges
    before, so no task sorts or numbers more than a range. The sorted rows are written, so that places and
    counts are of the same ranges.
    """
    written = written or Written(df.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE)).alias("place")
    placed = written.table(df.repartitionByRange(*order).sortWithinPartitions(*order).select(whole, F.spark_partition_id().alias("part"), place))
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())  # a row a partition
    starts, before = [], first
    for part, n in sizes:
        starts.append((part, before))
        before += n
    start = df.sparkSession.createDataFrame(starts, "part int, start long")
    return placed.join(F.broadcast(start), "part").select("whole.*", (F.col("start") + F.col("place")).alias(name))
