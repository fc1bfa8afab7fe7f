"""Mixing sources to target weights by fitting subset sums.

Targets: sources in code point order, null last, share all words by weights, none above REPEATS
times its own words; what is cut off is shared again by weight. A source whose target is more than
its words is taken whole as often as fits. What then remains of the budget is a subset sum: the
source's documents are counted by exact length, each length gives its proportional number, single
documents follow while the budget is large, and a bounded-knapsack dynamic programme over the
lengths that are left makes up the last words. Which documents of a length are taken is decided by
a seeded hash, so reruns agree.

Nulls: a null source is a source of its own, a null text has no words and is never taken. Repeated
rows are documents each for itself. Only doc_id, text and source are read. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlens.llm.common import Written, document, n_words, ranked, restored

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
SEED = 17
SALTS, SALT_ROWS = 64, 1_000_000  # parts that each length of a source is numbered in at least, and rows for each more
#: Words of budget that the dynamic programme fits, at most.
KNAPSACK_WORDS = 65536


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sizes (source, source_size), one row a source: adds source_no and target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row a source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_no"), F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("source_no", F.row_number().over(order) - 1).withColumn("weight", weight).withColumn("limit", repeats * F.col("source_size"))
    level, full = 0.0, -1
    while True:  # sources that reach their limit leave the sharing, until none is above
        above = F.lit(level) * F.col("weight") >= F.col("limit") if full >= 0 else F.lit(False)
        row = df.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("limit")).otherwise(0)).alias("held"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("w"), F.sum(above.cast("int")).alias("n")).first()
        if row["n"] is None or row["n"] == full or not row["w"]:
            break
        level, full = (row["all"] - row["held"]) / row["w"], row["n"]
    return df.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.col("limit").cast("double"))).drop("weight", "limit")


def knapsack(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many of each length to take for the largest sum within the budget; bounded counts."""
    items = []  # (length, copies): powers of two, so that any number up to the count can be made
    for length, count in zip(lengths, counts, strict=True):
        count, step = min(count, budget // length), 1
        while count > 0:
            items.append((length, min(step, count)))
            count, step = count - step, 2 * step
    full = (1 << budget + 1) - 1
    reached, by = 1, np.full(budget + 1, -1, dtype=np.int64)
    for i, (length, copies) in enumerate(items):
        new = (reached << length * copies) & full & ~reached
        if new:
            bits = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), dtype=np.uint8)
            by[np.flatnonzero(np.unpackbits(bits, bitorder="little")[: budget + 1])] = i
            reached |= new
            if reached >> budget & 1:
                break
    at, out = reached.bit_length() - 1, {}
    while at:  # a sum was first reached by its item, from a sum that earlier items reached
        length, copies = items[by[at]]
        out[length] = out.get(length, 0) + copies
        at -= length * copies
    return out


def fit(sizes: np.ndarray, counts: np.ndarray, target: float, most: int = KNAPSACK_WORDS, seed: int = SEED) -> tuple[int, np.ndarray]:
    """Whole repeats of a source, and how many documents of each size to take once more."""
    take = np.zeros(len(sizes), dtype=np.int64)
    total = int((sizes * counts).sum())
    if total == 0:
        return 0, take
    repeats = int(target // total)
    budget = int(round(target - repeats * total))
    if budget <= 0:
        return repeats, take
    take = np.where(sizes > 0, np.minimum(counts, counts * (budget / total)).astype(np.int64), 0)
    rest = budget - int((take * sizes).sum())
    order = np.random.default_rng(seed).permutation(len(sizes))
    while rest > most:
        before = rest
        for i in order:
            if 0 < sizes[i] <= rest and take[i] < counts[i] and rest > most:
                take[i] += 1
                rest -= int(sizes[i])
        if rest == before:
            break
    left = counts - take
    some = np.flatnonzero((sizes > 0) & (sizes <= rest) & (left > 0))
    if len(some) and rest <= most:
        for size, n in knapsack(sizes[some].tolist(), left[some].tolist(), rest).items():
            take[np.searchsorted(sizes, size)] += n
    return repeats, take


def _fit_source(df: pd.DataFrame) -> pd.DataFrame:
    """One source's counts by length: their number is bounded by the square root of twice its words."""
    df = df.sort_values("size")
    repeats, take = fit(df["size"].to_numpy(), df["n"].to_numpy(), float(df["target"].iloc[0]))
    return df[["source_no", "size"]].assign(repeats=repeats, take=take)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes) and the columns in carry of every document."""
    written = Written(docs.sparkSession)
    sized = written.table(docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("_hash"), *carry))
    shares = written.table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats))
    hist = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    hist = hist.join(F.broadcast(shares) if shares.count() <= 10_000 else shares, hist["source"].eqNullSafe(shares["source"])).select("source_no", "size", "n", "source_size", "target")
    fitted = hist.groupBy("source_no").applyInPandas(_fit_source, "source_no int, size long, repeats long, take long")
    fitted = written.table(fitted.join(hist.drop("n"), ["source_no", "size"]))
    numbered = sized.join(F.broadcast(shares) if shares.count() <= 10_000 else shares, sized["source"].eqNullSafe(shares["source"])).select("doc_id", "size", "source_no", "_hash", *carry)
    placed = ranked(numbered, ["source_no", "size"], F.pmod("_hash", F.lit(max(SALTS, sized.count() // SALT_ROWS))), ["_hash", "doc_id"], extra=fitted)
    taken = F.col("size") * (F.col("repeats") + (F.col("rank") < F.col("take")).cast("long"))
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "rank", "repeats", "take", *carry)


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs.

    Rows are told apart by their place in a written table, so null and repeated ids are taken like any other.
    """
    rows = Written(docs.sparkSession).table(docs.select(document(docs), F.monotonically_increasing_id().alias("row")))
    sized = rows.select("row", *[F.col("document").getField(c).alias(c) for c in ("doc_id", "text", "source")])
    times = mix(sized, carry=("row",)).where("taken > 0").select("row", F.expr("CAST(taken DIV size AS int)").alias("times"))
    again = rows.join(times, "row").select("document", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"))
    return restored(again, docs)
