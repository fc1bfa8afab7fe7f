"""Best-fit packing into sequences of several permitted lengths.

Only lengths matter to the packing, and no piece is longer than the largest permitted length, so
documents are first counted by length (a table of at most that many rows), and best-fit-decreasing
runs on the counts: a piece goes where the least room is left; where none fits, a sequence is
opened, of the permitted length whose expected cost a token is least, judged by filling one such
sequence from the lengths still unplaced; at the end each sequence is downsized to the least
permitted length that holds its contents. The plan (runs of equal pieces into runs of sequences)
is then applied to all rows in parallel, by the place of a row among those of its length.

Nulls: a null or empty text has no tokens; it gets one row with piece 0, length 0 and no sequence.
Longer texts are cut into whole sequences of the largest length and a rest. Repeated rows are packed
each for itself; equal lengths are placed by a hash of doc_id, then doc_id. An empty table gives an
empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import Written, n_words, ranked

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 32  # cost of a sequence besides its length
SALTS, SALT_ROWS = 64, 1_000_000  # parts that each length is numbered in at least, and rows of the commonest for each more
BIN_COLUMNS = ("bin_id", "bin_size", "bin_used", "bin_start")


def cost(length: int) -> int:
    return length + OVERHEAD


def plan(counts: dict[int, int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[tuple], list[tuple]]:
    """Best-fit-decreasing on counts by length.

    Placements (length, first rank, pieces, first sequence, pieces in each, tokens before) and
    sequences (first, end, permitted length, tokens).
    """
    left = {n: c for n, c in counts.items() if n > 0 and c > 0}
    ascending = sorted(left)
    room: dict[int, list[tuple[int, int, int]]] = {}  # room left: runs of sequences (first, end, tokens in each)
    rooms: list[int] = []
    placements: list[tuple] = []
    opened = 0

    def put(space: int, first: int, end: int, used: int) -> None:
        if space not in room:
            room[space] = []
            insort(rooms, space)
        room[space].append((first, end, used))

    def fill(size: int, length: int) -> dict[int, int]:
        """What one new sequence would hold: pieces of this length, then the longest of the rest that fit."""
        use, space = {}, size
        i = bisect_left(ascending, length)
        while i >= 0 and space > 0:
            n = ascending[i]
            if n <= space and (k := min(left[n], space // n)):
                use[n] = k
                space -= k * n
            i = min(i - 1, bisect_left(ascending, space + 1) - 1)
        return use

    for length in reversed(list(ascending)):
        rank, count = 0, left[length]
        while count:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                options = []
                for size in (s for s in lengths if s >= length):
                    use = fill(size, length)
                    options.append((cost(size) / sum(n * k for n, k in use.items()), size, use))
                _, size, use = min(options, key=lambda o: o[:2])
                many = min(left[n] // k for n, k in use.items())  # as often as the same choice can be made
                many = max(1, min(many, -(-count // (size // length))))
                put(size, opened, opened + many, 0)
                opened += many
                continue
            space = rooms[at]
            first, end, used = room[space].pop()
            if not room[space]:
                del room[space]
                rooms.pop(at)
            each = space // length
            whole, rest = divmod(min(count, (end - first) * each), each)
            took = whole * each + rest
            placements.append((length, rank, took, first, each, used))
            if whole:
                put(space - each * length, first, first + whole, used + each * length)
            if rest:
                put(space - rest * length, first + whole, first + whole + 1, used + rest * length)
            if (begin := first + whole + bool(rest)) < end:
                put(space, begin, end, used)
            rank, count = rank + took, count - took
            left[length] = count
        ascending.pop()
    sequences = [(a, b, lengths[bisect_left(lengths, used)], used) for runs in room.values() for a, b, used in runs if used]
    return placements, sorted(sequences)


def pieces_of(docs: DataFrame, longest: int) -> DataFrame:
    """doc_id, piece, start, length: whole sequences of the largest length, then the rest."""
    df = docs.select("doc_id", n_words().alias("n"))
    last = F.greatest(F.ceil(F.col("n") / longest) - 1, F.lit(0)).cast("int")
    df = df.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece").cast("long") * longest
    return df.select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(longest)).cast("int").alias("length"))


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_size, bin_used, bin_start (the piece's place in its sequence)."""
    lengths = tuple(sorted(lengths))
    spark = docs.sparkSession
    pieces = Written(spark).table(pieces_of(docs, lengths[-1]))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most lengths[-1] + 1 rows
    placements, sequences = plan(counts, lengths)
    placed = np.array(sorted(placements), dtype=np.int64).reshape(-1, 6)
    held = np.array(sequences, dtype=np.int64).reshape(-1, 4)
    sent = spark.sparkContext.broadcast((placed, held))  # bounded by the distinct lengths, not by the rows

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        placed, held = sent.value
        begins = placed[:, 0] * 2**48 + placed[:, 1]
        for df in batches:
            length, rank = df["length"].to_numpy(np.int64), df["rank"].to_numpy(np.int64)
            some = length > 0
            out = np.zeros((4, len(df)), dtype=np.int64)
            p = placed[np.searchsorted(begins, length[some] * 2**48 + rank[some], side="right") - 1]
            nth = rank[some] - p[:, 1]
            out[0, some] = p[:, 3] + nth // p[:, 4]
            out[3, some] = p[:, 5] + nth % p[:, 4] * p[:, 0]
            if len(held):
                s = held[np.searchsorted(held[:, 0], out[0, some], side="right") - 1]
                out[1, some], out[2, some] = s[:, 2], s[:, 3]
            new = {name: pd.array(values, dtype="Int64") for name, values in zip(BIN_COLUMNS, out, strict=True)}
            for values in new.values():
                values[~some] = pd.NA
            yield df[["doc_id", "piece", "start", "length"]].assign(**new)

    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(SALTS, max(counts.values(), default=0) // SALT_ROWS)))
    kind = dict(pieces.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length int, bin_id long, bin_size long, bin_used long, bin_start long"
    return ranked(pieces, ["length"], salt, ["doc_id", "piece"]).mapInPandas(assign, schema)
