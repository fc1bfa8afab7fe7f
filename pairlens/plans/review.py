"""The next lists after reviewers have judged some pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlens.functions.text import numbered_tokens
from pairlens.model import CandidateSet, KeyedTable
from pairlens.operators import bounded
from pairlens.operators.simjoin import label_of
from pairlens.plans.configs import Config
from pairlens.sources.shared import Written

RESERVE = 10  # times k: pairs a configuration that are ranked ahead


@dataclass
class Review:
    """A search whose next lists come from pairs ranked ahead, and from new rounds only when those run out.

    ranked has the first `depth` pairs of each configuration, written to the shared folder. Pairs that were judged
    are left out of it, as if they had been candidates from the start: what is left keeps its order, so the
    first k of it are what a new search would find, as long as k are left or no more pairs exist.
    """

    left: KeyedTable
    right: KeyedTable
    fields: tuple[list[str], list[str]]
    candidates: CandidateSet | None
    configs: list[Config]
    k: int
    depth: int = 0
    ranked: DataFrame | None = None
    searches: int = 0

    def _rank(self, depth: int) -> None:
        a = numbered_tokens(self.left.df, self.left.key, self.fields[0])
        b = numbered_tokens(self.right.df, self.right.key, self.fields[1])
        self.ranked = Written(self.left.df.sparkSession).table(bounded.configured_top(a, b, self.candidates, self.configs, depth))
        self.depth, self.searches = depth, self.searches + 1

    def next(self, judged: DataFrame | None = None) -> DataFrame:
        """config, lid, rid, shared, sim, rank: the first k pairs of each configuration that are not in judged (lid, rid)."""
        if self.ranked is None:
            self._rank(RESERVE * self.k)
        while True:
            left = self.ranked if judged is None else self.ranked.join(judged.select("lid", "rid").distinct(), ["lid", "rid"], "left_anti")
            have = {r["config"]: r["n"] for r in left.groupBy("config").agg(F.count("*").alias("n")).collect()}  # a row a configuration
            all_ = {r["config"]: r["n"] for r in self.ranked.groupBy("config").agg(F.count("*").alias("n")).collect()}
            # a configuration with fewer pairs than were asked for has no more
            if all(have.get(c, 0) >= self.k or all_.get(c, 0) < self.depth for c in map(label_of, self.configs)):
                break
            self._rank(2 * self.depth)
        order = Window.partitionBy("config").orderBy(F.desc("sim"), F.desc("lid"), F.desc("rid"))
        return left.select("config", "lid", "rid", "shared", "sim", F.row_number().over(order).alias("rank")).where(F.col("rank") <= self.k)
