"""Helpers that several corpus operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlens.sources.shared import Written, scratch, shared_dir


#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def document(docs: DataFrame) -> Column:
    """The whole row as one column, so that none of its names can clash with those of working columns."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")


def restored(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs out of document(), those named in new replaced."""
    return rows.select(*[new.get(c, F.col("document").getField(c)).alias(c) for c in docs.columns])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_words(name: str = "text") -> Column:
    """Number of words of a text; null counts as empty."""
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def ranked(df: DataFrame, keys: list[str], salt: Column, order: list[str], extra: DataFrame | None = None) -> DataFrame:
    """Adds rank: the 0-based place of a row among those of equal keys (not null).

    A key may hold a third of all rows, so no task sees a whole key: rows are numbered inside
    (keys, salt), and each such part starts after the counted rows of the parts before it.
    extra: columns by keys that are to be added on the way.
    """
    parts = df.withColumn("_salt", salt)
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    sizes = parts.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if extra is not None:
        starts = starts.join(extra, keys)
    local = parts.withColumn("_place", F.row_number().over(within) - 1)
    return local.join(starts, [*keys, "_salt"]).withColumn("rank", F.col("_start") + F.col("_place")).drop("_salt", "_start", "_place")


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the nodes of links (a, b): the nodes other than the smallest of their component, and that smallest one."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def components(edges: DataFrame, written: Written) -> DataFrame:
    """Connected components of links (a, b): node, root (the smallest node that it reaches), for nodes other than roots.

    Alternates large-star and small-star; either is a grouped minimum, combined before the shuffle,
    and a join that adaptive execution may split, so a node with very many links needs no single task.
    """

    def done(df: DataFrame) -> bool:
        """Whether all are stars: no node below two others, none both below one and above another."""
        ends = df.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionAll(df.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 OR below = 1 AND above = 1").isEmpty()

    def star(edges: DataFrame, large: bool) -> DataFrame:
        high = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        near = high.unionAll(high.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else high
        least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = near.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now = written.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not done(now):
        large = written.table(star(now, True))
        small = written.table(star(large, False))
        written.drop(now)
        written.drop(large)
        now = small
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
