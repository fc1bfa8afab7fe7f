"""Reviewers' verdicts on suggested pairs, and how many known matches are found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators.simjoin import jaccard


def label_state(labels: DataFrame) -> DataFrame:
    """The last verdict of each pair. labels: (iteration, lkey, rkey, label, at); a null label takes a verdict back."""
    last = labels.groupBy("lkey", "rkey").agg(F.max_by(F.struct("iteration", "label"), F.struct("at", "iteration", "label")).alias("x"))
    return last.select("lkey", "rkey", "x.iteration", "x.label").where("label IS NOT NULL")


def label_counts(state: DataFrame) -> DataFrame:
    """iteration, n_true, n_false."""
    return state.groupBy("iteration").agg(F.count_if(F.col("label")).alias("n_true"), F.count_if(~F.col("label")).alias("n_false"))


def gold_similarity(gold: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """lkey, rkey, sim of known matches, most similar first. left, right: numbered tokens (id, f, t)."""
    sets = lambda tokens, key, name: tokens.groupBy(F.col("id").alias(key)).agg(F.collect_set("t").alias(name))
    none = F.array().cast("array<string>")
    both = gold.join(sets(left, "lkey", "a"), "lkey", "left").join(sets(right, "rkey", "b"), "rkey", "left").withColumns({"a": F.coalesce("a", none), "b": F.coalesce("b", none)})
    sim = jaccard(F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b"))
    return both.select("lkey", "rkey", sim.alias("sim")).orderBy(F.desc("sim"), F.desc("lkey"), F.desc("rkey"))


def recall(top: DataFrame, gold: DataFrame) -> DataFrame:
    """config, n_found, n_gold, recall: known matches among suggested pairs (config, lid, rid)."""
    known = gold.select(F.col("lkey").alias("lid"), F.col("rkey").alias("rid")).distinct()
    total = known.agg(F.count("*").alias("n_gold"))
    found = top.select("config", "lid", "rid").join(known.withColumn("hit", F.lit(1)), ["lid", "rid"], "left").groupBy("config").agg(F.count("hit").alias("n_found"))
    return found.join(F.broadcast(total)).select("config", "n_found", "n_gold", F.when(F.col("n_gold") > 0, F.col("n_found") / F.nullif(F.col("n_gold"), F.lit(0))).otherwise(F.lit(0.0)).alias("recall"))
