"""What the debugger works on: keyed tables, the pairs that a blocker kept, and the fields to compare."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyedTable:
    """A table and the name of its key column."""

    df: DataFrame
    key: str


@dataclass(frozen=True)
class CandidateSet:
    """Pairs that a blocker kept; left_key and right_key name the columns with the keys.

    blocks: for pairs of equal values, (lid, block) and (rid, block) of both tables: a join that knows
    them leaves such pairs out while it runs, and need not look them up.
    """

    df: DataFrame
    left_key: str
    right_key: str
    blocks: tuple[DataFrame, DataFrame] | None = None

    def pairs(self) -> DataFrame:
        return self.df.select(F.col(self.left_key).alias("lid"), F.col(self.right_key).alias("rid"))


@dataclass(frozen=True)
class Feature:
    """A pair of columns to compare; field is its number among the chosen ones."""

    field: int
    left: str
    right: str
    weight: float
