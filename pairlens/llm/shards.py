"""Sharding by histogram sort, in DataFrame operations only.

Rows are sorted by a key (checksum of the text, then a hash of the id, so that equal texts lie
together, yet a group of copies of any size can be cut). Candidate boundaries are tried in rounds:
each round counts, over all rows, the exact bytes and rows of every cell between probes, and
refines the cells that hold a wanted splitter, until each splitter is within tolerance. Then whole
rows are exchanged once, by the ranges found, and written in their order.

Nulls: a null text has no bytes (size 1, checksum 0); a null doc_id is a row like any other. Equal
rows are told apart by their place in the written table, so they too can be cut. An empty table
gives an empty result. Columns other than doc_id and text are carried along, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlens.llm.common import Written, text_or_empty

KEYS = ("key", "place")
KEY_BITS = 63
FIRST_BITS = 12  # probes of the first round, as a power of two
MORE_BITS = 6  # probes of each later round inside a cell


@dataclass
class Probe:
    """The search for one splitter: the cell of 2**bits keys from low that holds its target weight."""

    target: float
    tolerance: float
    prefix: tuple = ()
    low: int = 0
    bits: int = KEY_BITS
    weight: int = 0  # below the cell
    rows: int = 0
    best: tuple = field(default_factory=tuple)  # (error, splitter, rows below)
    open: bool = True

    def cell(self) -> tuple:
        return self.prefix, self.low, self.bits

    def offer(self, splitter: tuple, weight: int, rows: int) -> None:
        error = abs(weight - self.target)
        if not self.best or error < self.best[0]:
            self.best = (error, splitter, rows)


def _inside(cell: tuple) -> Column:
    prefix, low, bits = cell
    level = len(prefix)
    cond = F.lit(True)
    for name, value in zip(KEYS, prefix, strict=False):
        cond = cond & (F.col(name) == F.lit(value))
    return cond if bits == KEY_BITS else cond & (F.shiftright(F.col(KEYS[level]), bits) == F.lit(low >> bits))


def _count(table: DataFrame, cells: list[tuple], step: int) -> dict[int, list[tuple[int, int, int]]]:
    """By number of the cell: (part, bytes, rows) of its 2**step parts, exactly, over all rows."""
    which = part = F.lit(None).cast("int")
    for i, cell in reversed(list(enumerate(cells))):
        prefix, low, bits = cell
        inside = _inside(cell)
        fine = max(0, bits - step)
        which = F.when(inside, F.lit(i)).otherwise(which)
        part = F.when(inside, F.shiftright(F.col(KEYS[len(prefix)]) - F.lit(low), fine).cast("int")).otherwise(part)
    counted = table.select(which.alias("cell"), part.alias("part"), "size").where("cell is not null").groupBy("cell", "part").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
    out: dict[int, list[tuple[int, int, int]]] = {i: [] for i in range(len(cells))}
    for r in counted.collect():  # at most 2**step rows for each splitter
        out[r["cell"]].append((r["part"], r["w"], r["n"]))
    return out


def splitters(table: DataFrame, probes: list[Probe]) -> list[tuple[tuple, int]]:
    """For each probe the boundary found (a row is above if its keys are not less) and the rows below it."""
    step = FIRST_BITS
    while any(p.open for p in probes):
        cells = list(dict.fromkeys(p.cell() for p in probes if p.open))
        counts = _count(table, cells, step)
        for p in (p for p in probes if p.open):
            parts = sorted(counts[cells.index(p.cell())])
            fine = max(0, p.bits - step)
            weight, rows = p.weight, p.rows
            p.offer((*p.prefix, p.low), weight, rows)
            held = None
            for part, w, n in parts:
                at = p.low + (part << fine)
                p.offer((*p.prefix, at), weight, rows)
                if weight + w >= p.target and held is None:
                    held = (at, weight, rows, n)
                weight, rows = weight + w, rows + n
                if at + (1 << fine) < 1 << KEY_BITS:
                    p.offer((*p.prefix, at + (1 << fine)), weight, rows)
            if held is None or p.best[0] <= p.tolerance or held[3] <= 1:
                p.open = False
            elif fine > 0:
                p.low, p.weight, p.rows, p.bits = *held[:3], fine
            elif len(p.prefix) + 1 < len(KEYS):  # many rows of one key: go on by their places
                p.prefix, p.weight, p.rows = (*p.prefix, held[0]), held[1], held[2]
                p.low, p.bits = 0, KEY_BITS
            else:
                p.open = False
        step = MORE_BITS
    return [(p.best[1], p.best[2]) for p in probes]


LEAST_RANGES, MOST_RANGES, RANGE_BYTES = 4, 64, 256 << 20  # parts that a shard is sorted in, and bytes of a part between


def _above(splitter: tuple) -> Column:
    key = F.col(KEYS[0])
    if len(splitter) == 1:
        return key >= F.lit(splitter[0])
    return (key > F.lit(splitter[0])) | ((key == F.lit(splitter[0])) & (F.col(KEYS[1]) >= F.lit(splitter[1])))


def sharded(docs: DataFrame, shards: int = 16, ranges_per_shard: int | None = None, tolerance: float = 0.001) -> DataFrame:
    """Every row, whole, as document, with size, text_crc32, shard and slot, as written by shard and slot; shards hold near equal bytes.

    tolerance: of a shard's mean bytes, for the boundaries of shards; a single text is never cut,
    so a boundary may miss by half the longest text. Each shard is sorted in ranges_per_shard parts, by default
    as many as its bytes need, LEAST_RANGES to MOST_RANGES: splitters are compared one by one.
    """
    written = Written(docs.sparkSession)
    text = text_or_empty()
    key = F.shiftleft(F.crc32(text.cast("binary")), 31).bitwiseOR(F.coalesce(F.xxhash64("doc_id"), F.lit(0)).bitwiseAND(F.lit(2**31 - 1)))
    document = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
    table = written.table(docs.select(document, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"), F.monotonically_increasing_id().alias("place")), compression="zstd")
    total = table.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if ranges_per_shard is None:
        ranges_per_shard = min(MOST_RANGES, max(LEAST_RANGES, total // (shards * RANGE_BYTES)))
    parts = shards * ranges_per_shard
    probes = [Probe(target=total * i / parts, tolerance=total / shards * (tolerance if i % ranges_per_shard == 0 else max(tolerance, 0.02))) for i in range(1, parts)] if total else []
    found = sorted(splitters(table, probes), key=lambda x: (x[1], x[0]))
    above = sum((_above(s).cast("int") for s, _ in found), F.lit(0))
    below = [0, *(n for _, n in found)]
    offsets = F.array(*[F.lit(below[i] - below[i // ranges_per_shard * ranges_per_shard]).cast("long") for i in range(len(below))])
    order = Window.partitionBy("range").orderBy("key", "document.doc_id", "place")
    placed = (
        table.withColumn("range", above)
        .withColumn("slot", (F.row_number().over(order) - 1).cast("long") + F.element_at(offsets, F.col("range") + 1))
        .select("document", "size", "text_crc32", F.floor(F.col("range") / ranges_per_shard).cast("int").alias("shard"), "slot")
    )
    out = written.table(placed, compression="zstd")
    written.drop(table)
    return out


def histogram_shards(docs: DataFrame, shards: int = 16, ranges_per_shard: int | None = None, tolerance: float = 0.001) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of the sharded rows."""
    return sharded(docs, shards, ranges_per_shard, tolerance).select("document.doc_id", "size", "text_crc32", "shard", "slot")
