"""The debugger: from two tables and a candidate set to the likely matches that the blocker lost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.functions.text import keyed_texts, kgrams, numbered_tokens, token_sets
from pairlens.model import CandidateSet, Feature, KeyedTable
from pairlens.operators import bounded, simjoin
from pairlens.operators.blockers import block_pairs
from pairlens.operators.features import cap_rule, half_rule, select_features
from pairlens.operators.schema_match import Correspondence, matched
from pairlens.operators.suggestions import decorated, recommendations
from pairlens.plans.configs import Config, leave_one_out, top_down

GRAM = 3


@dataclass(frozen=True)
class Report:
    """Suggestions of every configuration: ranked pairs, statistics, and what is needed to show them."""

    configs: list[Config]
    features: list[Feature]
    top: DataFrame
    left: KeyedTable
    right: KeyedTable
    correspondence: Correspondence
    candidates: CandidateSet | None

    @property
    def statistics(self) -> DataFrame:
        """Of each configuration: pairs considered, which takes the join of all tokens, and mean lengths."""
        a = numbered_tokens(self.left.df, self.left.key, [f.left for f in self.features])
        b = numbered_tokens(self.right.df, self.right.key, [f.right for f in self.features])
        ids = [t.df.select(F.col(t.key).alias("id")) for t in (self.left, self.right)]
        return iteration_statistics(bounded.considered(a, b, self.candidates, self.configs), a, b, *ids, self.configs)

    def recommendations(self) -> DataFrame:
        return recommendations(self.top, self.left, self.right, self.correspondence)


def debug_blocker(left: KeyedTable, right: KeyedTable, candidates: CandidateSet | None, k: int = 200, given: Correspondence | None = None, how: str = "auto") -> DataFrame:
    """The k pairs outside the candidates most alike in the 3-grams of their fields, both rows side by side."""
    left, right, pairs = matched(left, right, k, given)
    chosen = select_features(left, right, pairs, half_rule, "sum")
    texts = keyed_texts(left.df, left.key, [f.left for f in chosen]), keyed_texts(right.df, right.key, [f.right for f in chosen])
    return decorated(bounded.top_k_texts(*texts, lambda text: kgrams(text, GRAM), candidates, k, how), left, right, pairs)


def debug_blocker_token_sets(left: KeyedTable, right: KeyedTable, candidates: CandidateSet | None, k: int = 200, given: Correspondence | None = None, how: str = "auto") -> DataFrame:
    """The same, by the sets of tokens of all fields."""
    left, right, pairs = matched(left, right, k, given)
    chosen = select_features(left, right, pairs, half_rule, "sum")
    docs = token_sets(left.df, left.key, [f.left for f in chosen]), token_sets(right.df, right.key, [f.right for f in chosen])
    return decorated(bounded.top_k(*docs, candidates, k, how), left, right, pairs)


def check_keys(table: KeyedTable, name: str) -> None:
    if not table.df.groupBy(F.col(table.key)).count().where("count > 1").isEmpty():
        raise ValueError(f"the {name} table has a key twice")


def named_keys(candidates: CandidateSet) -> tuple[DataFrame, DataFrame]:
    """The keys of either side that the candidates name (one column, repeats); from blocks without forming their pairs."""
    if candidates.blocks is None:
        pairs = candidates.pairs()
        return pairs.select("lid"), pairs.select("rid")
    a, b = candidates.blocks
    return a.join(b.select("block"), "block", "left_semi").select("id"), b.join(a.select("block"), "block", "left_semi").select("id")


def unknown_keys(candidates: CandidateSet, left: KeyedTable, right: KeyedTable) -> DataFrame:
    """side, key: keys of the candidates, compared as text, that their table does not have."""
    found = []
    for name, named, table in zip(("left", "right"), named_keys(candidates), (left, right), strict=True):
        known = table.df.select(F.col(f"`{table.key}`").cast("string").alias("key"))
        keys = named.toDF("key").select(F.lit(name).alias("side"), F.col("key").cast("string").alias("key")).distinct()
        found.append(keys.join(known, "key", "left_anti").select("side", "key"))
    return found[0].unionAll(found[1])


def indexed_candidates(candidates: CandidateSet, left: KeyedTable, right: KeyedTable) -> CandidateSet:
    """The candidates with the keys of the tables, which theirs equal as text; a key that a table does not have is an error."""
    if not unknown_keys(candidates, left, right).isEmpty():
        raise ValueError("the candidates name a key that its table does not have")
    if candidates.blocks is not None:
        a, b = (_indexed(block, "id", table) for block, table in zip(candidates.blocks, (left, right), strict=True))
        return CandidateSet(block_pairs(a, b), "lid", "rid", (a, b))
    return CandidateSet(_indexed(_indexed(candidates.pairs(), "lid", left), "rid", right), "lid", "rid")


def _indexed(rows: DataFrame, name: str, table: KeyedTable) -> DataFrame:
    """rows with the keys of the table in the column of that name, which equal them as text."""
    kind = table.df.schema[table.key].dataType
    if rows.schema[name].dataType == kind:
        return rows
    if isinstance(kind, T.StringType | T.IntegralType):  # a text is of one such key: nothing to look up
        return rows.withColumn(name, F.col(name).cast("string").try_cast(kind))
    known = table.df.select(F.col(f"`{table.key}`").alias("native"), F.col(f"`{table.key}`").cast("string").alias("text"))
    return rows.join(known, F.col(name).cast("string") == F.col("text")).withColumn(name, F.col("native")).drop("native", "text")


def token_counts(tokens: DataFrame, n: int) -> list[int]:
    """Tokens of each of n fields, over all records."""
    found = {r["f"]: r["n"] for r in tokens.groupBy("f").agg(F.count("*").alias("n")).collect()}  # a row a field
    return [found.get(f, 0) for f in range(n)]


def iteration_statistics(considered: DataFrame, left: DataFrame, right: DataFrame, l_ids: DataFrame, r_ids: DataFrame, configs: list[Config]) -> DataFrame:
    """config, n_pairs, mean_llen, mean_rlen. considered: (config, n_pairs); means are over all records, those without tokens too."""
    means = []
    for tokens, ids in ((left, l_ids), (right, r_ids)):
        lengths = simjoin.record_lengths(tokens, ids, configs)
        means.append(lengths.agg(*[F.avg(f"n{i}").alias(f"n{i}") for i in range(len(configs))]))
    rows = means[0].join(F.broadcast(means[1].toDF(*[f"m{i}" for i in range(len(configs))])))  # a row each
    shape = rows.select(F.inline(F.array(*[F.struct(F.lit(simjoin.label_of(c)).alias("config"), F.col(f"n{i}").alias("mean_llen"), F.col(f"m{i}").alias("mean_rlen")) for i, c in enumerate(configs)])))
    return shape.join(considered, "config", "left").select("config", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "mean_llen", "mean_rlen")


def _iterative(left: KeyedTable, right: KeyedTable, candidates: CandidateSet | None, k: int, given: Correspondence | None, rule, weighting: str, plan, how: str) -> Report:
    left, right, pairs = matched(left, right, k, given)
    chosen = select_features(left, right, pairs, rule, weighting)
    check_keys(left, "left")
    check_keys(right, "right")
    if candidates is not None:
        candidates = indexed_candidates(candidates, left, right)
    a = numbered_tokens(left.df, left.key, [f.left for f in chosen])
    b = numbered_tokens(right.df, right.key, [f.right for f in chosen])
    configs = plan(chosen, a, b)
    return Report(configs, chosen, bounded.configured_top(a, b, candidates, configs, k, how), left, right, pairs, candidates)


def debug_leave_one_out(left: KeyedTable, right: KeyedTable, candidates: CandidateSet | None, k: int = 100, given: Correspondence | None = None, how: str = "auto") -> Report:
    """Lists for all fields, and for all but each one."""
    return _iterative(left, right, candidates, k, given, half_rule, "sum", lambda chosen, a, b: leave_one_out(len(chosen)), how)


def debug_top_down(left: KeyedTable, right: KeyedTable, candidates: CandidateSet | None, k: int = 100, given: Correspondence | None = None, how: str = "auto") -> Report:
    """Lists for fields removed level by level; the sequence needs weights and token counts only, so it is known before any join."""
    plan = lambda chosen, a, b: top_down([f.weight for f in chosen], token_counts(a, len(chosen)), token_counts(b, len(chosen)))
    return _iterative(left, right, candidates, k, given, cap_rule, "mean", plan, how)
