"""Verdicts as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairlens.operators.verify import label_state

SCHEMA = "iteration int, lkey long, rkey long, label boolean, at timestamp"
STATE = "iteration int, label boolean, at timestamp"
CHANGES = "lkey long, rkey long, iteration int, label boolean, at timestamp, expired boolean"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Verdicts from a folder of JSON files, as they arrive."""
    return spark.readStream.schema(SCHEMA).json(path)


def running_state(labels: DataFrame) -> DataFrame:
    """The last verdict of each pair so far, for ever; to be written in update or complete mode."""
    return label_state(labels)


def _order(iteration, label, at) -> tuple:
    """Verdicts in time; of one moment by iteration, then false before true, missing ones first."""
    plain = lambda x: (False, 0) if x is None or pd.isna(x) else (True, int(x))
    return at, plain(iteration), plain(label)


def _last(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, keep_ms: int) -> Iterator[pd.DataFrame]:
    """Holds the last verdict of a pair; gives it out when it changes, and when it is let go."""
    columns = [c.split()[0] for c in CHANGES.split(", ")]
    as_row = lambda held, gone: pd.DataFrame([[*key, *held, gone]], columns=columns).astype({"iteration": "Int32", "label": "boolean"})
    if state.hasTimedOut:
        held = state.get
        state.remove()
        yield as_row(held, True)
        return
    before = tuple(state.get) if state.exists else None
    best = before
    for batch in batches:
        for row in batch[["iteration", "label", "at"]].itertuples(index=False, name=None):
            row = tuple(None if pd.isna(x) else x for x in row)
            if best is None or _order(*row) > _order(*best):
                best = row
    if best is None:
        return
    if best != before:
        state.update((None if best[0] is None else int(best[0]), None if best[1] is None else bool(best[1]), best[2]))
        yield as_row(best, False)
    state.setTimeoutTimestamp(int(best[2].timestamp() * 1000) + keep_ms)


def verdict_changes(labels: DataFrame, late: str = "1 hour", keep_ms: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """A row whenever the last verdict of a pair changes (null label: taken back), or is let go after keep_ms without a newer one (expired).

    The state of a pair is one verdict, and none is held longer than keep_ms behind the watermark. Verdicts later than `late` are
    dropped, and so are those without a time. To be written in update mode.
    """
    known = labels.where("at IS NOT NULL").withWatermark("at", late)
    change = lambda key, batches, state: _last(key, batches, state, keep_ms)
    return known.groupBy("lkey", "rkey").applyInPandasWithState(change, CHANGES, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def running_counts(labels: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Verdicts of either kind by window of time, of those no later than late."""
    spans = labels.withWatermark("at", late).groupBy(F.window("at", window))
    return spans.agg(F.count_if(F.col("label")).alias("n_true"), F.count_if(~F.col("label")).alias("n_false")).select(F.col("window.start").alias("start"), "n_true", "n_false")
