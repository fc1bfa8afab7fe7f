"""Near duplicates by SimHash: a binary trie of fingerprints is joined with itself.

Fingerprints (64 bits over 3-word shingles) are grouped, so copies count once. Node pairs are split
from the root down, a few bits at a time, by joins on the nodes that exist: their differing bits are
added up, and pairs beyond the budget of ERRORS bits are dropped. A pair is split until it holds few
enough fingerprints, so a populous prefix is cut deeper than others and needs no task of its own.
Below, each task walks its node pairs together, bit by bit: children on equal sides keep the error
budget, children on unequal sides spend one, and a pair is pruned when the budget is exceeded.
Links of a task are reduced to a spanning forest; components are joined over all tasks.

Nulls: a null or empty text has fingerprint zero and is linked like any other. A text with fewer
than three words is one shingle. Repeated rows share fingerprint and component. An empty table
gives an empty result. Only doc_id and text are read. The pipeline's stage, which keeps one document
of each group at five words and similarity 0.8, is in `similar.py` and joins the same trie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import Written, components, local_components

SHINGLE = 3
SEED = 42
ERRORS = 2
BITS = 64
STEP = 4  # bits by which a node pair is split
NODE_ROWS = 32768  # fingerprints in a node pair that one task walks, at most
TASK_ROWS = 400_000
SMALL = 16  # node pairs with no more pairs of fingerprints are compared outright
CHUNK = 1 << 16  # shingles unpacked at once


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) <= SHINGLE:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), dtype="<u8", count=len(starts)))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(j) for j in np.flatnonzero(2 * ones > len(hashes)))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def trie_join(key: np.ndarray, right: np.ndarray, fp: np.ndarray, errors: int = ERRORS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints within the budget, of all node pairs of a task.

    key: the node pair that a row is in; right: whether it is in its second node (a node paired with itself has none); fp: unsigned.
    """
    order = np.lexsort((fp, right, key))
    key, right, fp = key[order], right[order], fp[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    end = np.concatenate([begin[1:], [len(key)]])[: len(begin)]
    rights = np.concatenate([[0], np.cumsum(right)])
    cut = end - (rights[end] - rights[begin])
    own = cut == end
    a = np.stack([begin, cut])
    b = np.stack([np.where(own, begin, cut), end])
    budget = np.full(len(begin), errors)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    for bit in range(BITS - 1, -2, -1):
        alive = (a[1] > a[0]) & (b[1] > b[0]) & (budget >= 0)
        a, b, budget = a[:, alive], b[:, alive], budget[alive]
        pairs = (a[1] - a[0]) * (b[1] - b[0])
        leaf = (pairs <= SMALL) | (bit < 0)
        x, y = _outright(fp, a[:, leaf], b[:, leaf], errors)
        left.append(x)
        right.append(y)
        a, b, budget = a[:, ~leaf], b[:, ~leaf], budget[~leaf]
        if bit < 0 or not len(budget):
            break
        set_before = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)).astype(np.int64) & 1)])
        mid_a = a[1] - (set_before[a[1]] - set_before[a[0]])
        mid_b = b[1] - (set_before[b[1]] - set_before[b[0]])
        a0, a1 = np.stack([a[0], mid_a]), np.stack([mid_a, a[1]])
        b0, b1 = np.stack([b[0], mid_b]), np.stack([mid_b, b[1]])
        two = a[0] != b[0]  # a node with itself: one of the two unequal pairs is enough
        a = np.concatenate([a0, a1, a0, a1[:, two]], axis=1)
        b = np.concatenate([b0, b1, b1, b0[:, two]], axis=1)
        budget = np.concatenate([budget, budget, budget - 1, budget[two] - 1])
    return np.concatenate([*left, fp[:0]]), np.concatenate([*right, fp[:0]])


def _outright(fp: np.ndarray, a: np.ndarray, b: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray]:
    na, nb = a[1] - a[0], b[1] - b[0]
    n = na * nb
    which = np.repeat(np.arange(len(n)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i = a[0][which] + nth // nb[which]
    j = b[0][which] + nth % nb[which]
    near = (i != j) & (np.bitwise_count(fp[i] ^ fp[j]) <= errors)
    return fp[i[near]], fp[j[near]]


def _prefix(depth: int) -> Column:
    """The trie's node of a fingerprint at a depth."""
    return F.col("fp") if depth == BITS else F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")


def node_pairs(prints: DataFrame, errors: int, written: Written) -> list[tuple[int, DataFrame]]:
    """Pairs (a, b) of nodes that exist and whose prefixes are within the budget, by depth; each has NODE_ROWS fingerprints at most.

    Larger pairs are split into pairs of their children, STEP bits at a time, from the root down.
    """
    rows = prints.agg(F.count("*").alias("n"))
    pairs = rows.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(errors).alias("budget"), F.col("n").alias("na"), F.col("n").alias("nb"))
    out, depth = [], 0
    while True:
        pairs = written.table(pairs)
        large = F.when(F.col("a") == F.col("b"), F.col("na")).otherwise(F.col("na") + F.col("nb")) > NODE_ROWS
        out.append((depth, pairs.where(~large).select("a", "b")))
        rest = pairs.where(large).select("a", "b", "budget")
        if depth == BITS or rest.isEmpty():
            return out
        inside = rest.select(F.col("a").alias("p")).unionAll(rest.select("b")).distinct()
        deeper = prints.select("fp", _prefix(depth).alias("p")).join(inside, "p", "left_semi").groupBy(_prefix(depth + STEP).alias("c")).agg(F.count("*").alias("n"))
        kids = written.table(deeper.select(F.shiftrightunsigned("c", STEP).alias("p"), "c", "n"))
        side = lambda s: kids.select(F.col("p").alias(s), F.col("c").alias(f"{s}_"), F.col("n").alias(f"n{s}"))  # noqa: B023, E731
        both = rest.join(side("a"), "a").join(side("b"), "b")
        spent = F.bit_count(F.col("a_").bitwiseXOR(F.col("b_")).bitwiseAND(F.lit((1 << STEP) - 1)))
        both = both.withColumn("budget", F.col("budget") - spent).where((F.col("budget") >= 0) & ((F.col("a") != F.col("b")) | (F.col("a_") <= F.col("b_"))))
        pairs, depth = both.select(F.col("a_").alias("a"), F.col("b_").alias("b"), "budget", "na", "nb"), depth + STEP


def links(prints: DataFrame, written: Written, errors: int = ERRORS) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp: every component of each task keeps a spanning star."""
    parts = []
    for depth, pairs in node_pairs(prints, errors, written):
        named = pairs.withColumn("key", F.xxhash64("a", "b", F.lit(depth)))
        sides = named.select("key", F.lit(False).alias("right"), F.col("a").alias("p")).unionAll(named.where("a <> b").select("key", F.lit(True), "b"))
        parts.append(prints.select("fp", _prefix(depth).alias("p")).join(sides, "p").select("key", "right", "fp"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionAll(part)
    rows = written.table(rows)
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK_ROWS)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(df["key"].to_numpy(), df["right"].to_numpy(), df["fp"].to_numpy()) for df in batches]
        if parts:
            key, right, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
            x, y = trie_join(key, right, fp.view(np.uint64), errors)
            node, root = local_components(x.view(np.int64), y.view(np.int64))
            yield pd.DataFrame({"a": node, "b": root})

    return rows.repartition(tasks, "key").mapInPandas(walk, "a long, b long")


def near_duplicates(docs: DataFrame, errors: int = ERRORS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links)."""
    written = Written(docs.sparkSession)
    prints = written.table(with_fingerprints(docs))
    nodes = written.table(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    joined = components(links(nodes.select("fp"), written, errors), written)
    rooted = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
