"""Counts of shared tokens by field: every pair counts, none is formed."""

from collections import Counter

from pyspark.sql import functions as F

from pairlens.functions.text import numbered_tokens
from pairlens.operators import simjoin
from pairlens.operators.field_counts import field_count_totals
from pairlens.plans.queries import pair_field_counts

FIELDS = ["a", "b", "c"]


def by_pairs(left, right):
    """The same from the pairs themselves."""
    counts = simjoin.pair_field_counts(left, right).groupBy("lf", "rf", "cnt")
    return counts.agg(F.count("*"), F.sum("lid"), F.sum("rid"))


def test_totals_equal_those_of_pairs(spark):
    words = "red blue red green".split()
    row = lambda i: (i, " ".join(words[j] for j in range(4) if i >> j & 1) or None, words[i % 3] if i % 7 else "", "blue  red" if i % 5 else "only" + str(i))
    tables = [spark.createDataFrame([row(i) for i in range(s, 90, 2)], "id long, a string, b string, c string").repartition(3) for s in (0, 1)]
    left, right = (numbered_tokens(t, "id", FIELDS) for t in tables)
    got = field_count_totals(left, right)
    assert got.columns == ["lf", "rf", "cnt", "n_pairs", "sum_lid", "sum_rid"]
    want = sorted(map(tuple, by_pairs(left, right).collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 9
    assert field_count_totals(left, right.where("false")).count() == 0


def test_many_rows_of_few_sets(spark, tmp_path):
    """4e10 pairs of rows: 200 000 of either side, of a few texts."""
    n = 400_000
    names, brands = ["red ring", "old red", "hot bolt"], ["Brand#1", "Brand#2"]
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (F.expr(f"CAST(id DIV 2 % {by} AS INT)") % len(xs)) + 1)
    parts = spark.range(n).select(F.col("id").alias("p_partkey"), pick(names, 3).alias("p_name"), pick(brands, 2).alias("p_brand"), F.lit("LARGE").alias("p_type"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.lf, r.rf, r.cnt): (r.n_pairs, r.sum_lid, r.sum_rid) for r in pair_field_counts(spark, str(tmp_path)).collect()}
    sides = []
    for s in (0, 1):
        sets = {}
        for i in range(s, n, 2):
            key = (i // 2 % 3, i // 2 % 2)
            m, total = sets.get(key, (0, 0))
            sets[key] = m + 1, total + i
        sides.append(sets)
    want = Counter(), Counter(), Counter()
    for (x, b), (ln, lids) in sides[0].items():
        for (y, c), (rn, rids) in sides[1].items():
            for f, cnt in ((0, len(set(names[x].split()) & set(names[y].split()))), (1, int(b == c)), (2, 1)):
                if cnt:
                    for total, v in zip(want, (ln * rn, lids * rn, rids * ln), strict=True):
                        total[f, f, cnt] += v
    assert got == {k: tuple(t[k] for t in want) for k in want[0]}
    assert sum(v[0] for k, v in got.items() if k[0] == 2) == (n // 2) ** 2
