"""Near duplicates among embeddings by epsilon grid order.

Equal vectors of a label are one class. Class representatives are laid in a grid over the leading
principal dimensions (of the covariance of all of them), its cells half as wide as the distance that
the least cosine allows between unit vectors, and sorted by cell. The sorted sequence is cut into
leaves, where a cell ends or a leaf is full; leaves make blocks, blocks intervals, intervals larger
intervals. Intervals are joined with each other from the largest down: a pair whose bounding boxes,
over more of the dimensions than the grid has, lie further apart than the distance is dropped, any
other is split into pairs of their parts. Pairs of blocks are dropped where all their leaves are
apart, before any vector moves; of those that remain, some of either side are sent to one task
together, which compares the vectors of leaves that are not apart. A task returns a sum and a
spanning forest, not its links one by one.

Labels must be equal and not null; vectors that are null, empty, zero, or hold null or non-finite
components link with nothing. Vectors of different lengths are never compared. Repeated rows are
vectors each for itself. An empty table gives an empty result. Only vec_id, embedding and label are
read. Classes are told apart by a number, not by vec_id, which may be null or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import Written, components, local_components, ranked

COSINE = 0.93
GRID = 8  # leading principal dimensions that vectors are sorted by
DIMENSIONS = 16  # leading principal dimensions of bounding boxes
LEAF = 32  # vectors
BLOCK = 512  # vectors
TOGETHER = 4  # blocks of either side that one task compares
DENSE = 0.25  # share of pairs of leaves beyond which all vectors of two blocks are compared at once
FAN = 8  # intervals in the next larger one
MARGIN = 1e-9


def rows_of(values: pa.Array) -> np.ndarray:
    """A list column whose lists are equally long, as a matrix of doubles."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors by powers of two, so that no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def comparable() -> Column:
    x = F.col("embedding")
    value = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.coalesce(F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, value) & F.exists(x, lambda v: v != 0), F.lit(False))


def principal_axes(classes: DataFrame, dimensions: int = DIMENSIONS) -> dict[int, np.ndarray]:
    """By length of vectors: the leading eigenvectors of the covariance of all their directions."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims):
                u = units(rows_of(batch.column(1).filter(pa.array(dims == dim))))
                u = np.concatenate([u, np.ones((len(u), 1))], axis=1)
                sums[dim] = sums.get(dim, 0) + u.T @ u
        for dim, m in sums.items():
            n = len(m)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], ["dim", "i", "m"])

    parts = classes.select("dim", "embedding").mapInArrow(moments, "dim int, i int, m array<double>")
    cells = parts.select("dim", "i", F.posexplode("m").alias("j", "x")).groupBy("dim", "i", "j").agg(F.sum("x").alias("x"))
    out: dict[int, np.ndarray] = {}
    for dim, rows in cells.toPandas().groupby("dim"):  # the square of a vector's length
        m = np.zeros((dim + 1, dim + 1))
        m[rows["i"], rows["j"]] = rows["x"]
        mean = m[-1, :-1] / m[-1, -1]
        _, axes = np.linalg.eigh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))
        out[int(dim)] = axes[:, ::-1][:, :dimensions]
    return out


def _names() -> list[str]:
    return [f"p{k}" for k in range(DIMENSIONS)]


def in_blocks(classes: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """classes in grid order, with block (rising along the order), leaf (rising in a block) and place in the leading dimensions p0, p1, ..."""
    kind = dict(classes.dtypes)
    names = _names()
    width = eps / 2
    schema = f"label {kind['label']}, dim int, rep {kind['rep']}, n long, embedding {kind['embedding']}, " + ", ".join(f"{p} double" for p in names)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                at = units(rows_of(part.column("embedding"))) @ axes[int(dim)]
                at = np.pad(at, ((0, 0), (0, DIMENSIONS - at.shape[1])))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(np.ascontiguousarray(at[:, k])) for k in range(DIMENSIONS))], [*part.schema.names, *names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, leaf, filled, in_leaf, last, cell = TaskContext.get().partitionId() << 32, 0, 0, 0, 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks, leaves = np.empty(batch.num_rows, dtype=np.int64), np.empty(batch.num_rows, dtype=np.int32)
            cells = np.stack([np.floor(batch.column(p).to_numpy() / width) for p in names[:GRID]], axis=1)
            moved = np.any(cells != np.concatenate([cells[:1] if cell is None else cell, cells[:-1]]), axis=1)
            cell = cells[-1:]
            for i, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True)):
                if key != last or filled == BLOCK:
                    block, leaf, filled, in_leaf, last = block + 1, 0, 0, 0, key
                elif moved[i] or in_leaf == LEAF:
                    leaf, in_leaf = leaf + 1, 0
                filled, in_leaf = filled + 1, in_leaf + 1
                blocks[i], leaves[i] = part | block, leaf
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks), pa.array(leaves)], [*batch.schema.names, "block", "leaf"])

    placed = classes.select("label", "dim", "rep", "n", "embedding").mapInArrow(project, schema)
    order = ["label", "dim", *(F.floor(F.col(p) / width) for p in names[:GRID]), "rep"]
    tasks = max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(cut, schema + ", block long, leaf int")


def _near(a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray, eps: float) -> np.ndarray:
    """Which boxes of a (rows) and b (columns) lie within eps."""
    apart = np.zeros((len(a_lo), len(b_lo)))
    for k in range(a_lo.shape[1]):
        gap = np.maximum(0, np.maximum(a_lo[:, k, None] - b_hi[:, k], b_lo[:, k] - a_hi[:, k, None]))
        apart += gap * gap
    return apart <= eps * eps + MARGIN


def near_blocks(blocks: DataFrame, eps: float, written: Written) -> DataFrame:
    """Pairs (label, dim, a, b, a_block, b_block) of blocks some of whose leaves lie within eps, found by splitting pairs of intervals; a, b: the blocks' places in the order."""
    names = _names()
    ends = [f(p).alias(f"{s}{p}") for p in names for f, s in ((F.min, "lo_"), (F.max, "hi_"))]
    merged = [f(F.col(f"{s}{p}")).alias(f"{s}{p}") for p in names for f, s in ((F.min, "lo_"), (F.max, "hi_"))]
    box = F.array(*[F.col(f"{s}{p}") for s in ("lo_", "hi_") for p in names])
    leaves = blocks.groupBy("label", "dim", "block", "leaf").agg(*ends)
    boxes = leaves.groupBy("label", "dim", "block").agg(*merged, F.flatten(F.collect_list(box)).alias("leaves"))  # at most BLOCK
    boxes = written.table(ranked(boxes, ["label", "dim"], F.shiftright("block", 32), ["block"]).withColumnRenamed("rank", "node"))
    most = boxes.agg(F.coalesce(F.max("node"), F.lit(0))).first()[0] + 1
    levels = 0
    while FAN**levels < most:
        levels += 1
    pairs = boxes.select("label", "dim").distinct().select("label", "dim", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in range(levels - 1, -1, -1):
        at = boxes.drop("leaves") if level == 0 else boxes.withColumn("node", F.floor(F.col("node") / FAN**level)).groupBy("label", "dim", "node").agg(*merged)
        at = at.withColumn("above", F.floor(F.col("node") / FAN))
        side = lambda s: at.select("label", "dim", F.col("above").alias(s), F.col("node").alias(f"{s}_node"), *[F.col(f"{e}_{p}").alias(f"{s}_{e}_{p}") for p in names for e in ("lo", "hi")])  # noqa: B023, E731
        gap = lambda p: F.greatest(F.lit(0.0), F.col(f"a_lo_{p}") - F.col(f"b_hi_{p}"), F.col(f"b_lo_{p}") - F.col(f"a_hi_{p}"))
        apart = sum((gap(p) * gap(p) for p in names), F.lit(0.0))
        both = pairs.join(side("a"), ["label", "dim", "a"]).join(side("b"), ["label", "dim", "b"])
        pairs = written.table(both.where((F.col("a_node") <= F.col("b_node")) & (apart <= eps * eps + MARGIN)).select("label", "dim", F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    named = lambda s: boxes.select("label", "dim", F.col("node").alias(s), F.col("block").alias(f"{s}_block"), F.col("leaves").alias(f"{s}_leaves"))
    both = pairs.join(named("a"), ["label", "dim", "a"]).join(named("b"), ["label", "dim", "b"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda v: np.asarray(v.values).reshape(-1, 2, DIMENSIONS)
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a_leaves"), batch.column("b_leaves"), strict=True):
                x, y = of(a), of(b)
                keep.append(bool(_near(x[:, 0], x[:, 1], y[:, 0], y[:, 1], eps).any()))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["label", "dim", "a", "b", "a_block", "b_block"])

    kind = dict(blocks.dtypes)
    return both.select("label", "dim", "a", "b", "a_block", "b_block", "a_leaves", "b_leaves").mapInArrow(close, f"label {kind['label']}, dim int, a long, b long, a_block long, b_block long")


def _links(x: np.ndarray, u: np.ndarray, at: np.ndarray, leaf: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked vectors of two blocks, whose places a and b are sorted by leaf: each pair once; pairs of one place are left out."""

    def some(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = u[i] @ u[j].T
        near = s >= cosine
        for k, m in zip(*np.nonzero(np.abs(s - cosine) < MARGIN), strict=True):
            v, w = x[i[k]], x[j[m]]
            near[k, m] = v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= cosine
        k, m = np.nonzero(near)
        return i[k], j[m]

    starts = lambda i: np.flatnonzero(np.concatenate([[True], leaf[i][1:] != leaf[i][:-1]]))
    sa, sb = starts(a), starts(b)
    boxes = [f.reduceat(at[i], s) for i, s in ((a, sa), (b, sb)) for f in (np.minimum, np.maximum)]
    near = _near(*boxes, float(np.sqrt(2 - 2 * cosine)))
    if near.mean() > DENSE:
        return some(a, b)
    out = [(a[:0], b[:0])]
    which = np.cumsum(np.bincount(sb, minlength=len(b))) - 1  # the leaf of each of b
    for k, (begin, end) in enumerate(zip(sa, [*sa[1:], len(a)], strict=True)):
        if near[k].any():
            out.append(some(a[begin:end], b[near[k][which]]))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def compare(rows: pa.Table, cosine: float, axes: dict[int, np.ndarray]) -> pa.Table:
    """For pairs of blocks, the vectors that have links in them: rep, linked (vectors), root (least of its links' component).

    rows: block, leaf, rep, n, embedding, partners: the blocks that a block is compared with, none for one that is only a partner."""
    rows = rows.sort_by([("block", "ascending"), ("leaf", "ascending")])
    x = rows_of(rows.column("embedding").combine_chunks())
    u, x = units(x), scaled(x)
    at = u @ axes[x.shape[1]]
    rep, n, block, leaf = (rows.column(c).to_numpy() for c in ("rep", "n", "block", "leaf"))
    which, begin = np.unique(block, return_index=True)
    place = {int(k): np.arange(s, e) for k, s, e in zip(which, begin, [*begin[1:], len(block)], strict=True)}
    partners = {k: rows.column("partners")[int(i[0])].as_py() or [] for k, i in place.items()}
    linked = np.zeros(len(rep), dtype=np.int64)
    left, right = [rep[:0]], [rep[:0]]
    for a, others in partners.items():
        for b in others:
            i, j = _links(x, u, at, leaf, place[a], place[b], cosine)
            if a == b:
                i, j = i[i < j], j[i < j]
            np.add.at(linked, i, n[j])
            np.add.at(linked, j, n[i])
            left.append(rep[i])
            right.append(rep[j])
    node, root = local_components(np.concatenate(left), np.concatenate(right))
    least = dict(zip(node.tolist(), root.tolist(), strict=True))
    some = np.flatnonzero(linked)
    return pa.table({"rep": rep[some], "linked": linked[some], "root": pa.array([least.get(r, r) for r in rep[some].tolist()], rows.schema.field("rep").type)})


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    written = Written(vectors.sparkSession)
    vectors = vectors.select("vec_id", "embedding", "label")
    valid = vectors.where(comparable())
    classes = written.table(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n")).withColumn("dim", F.size("embedding")).withColumn("rep", F.monotonically_increasing_id()))
    eps = float(np.sqrt(2 - 2 * cosine))
    axes = principal_axes(classes)
    blocks = written.table(in_blocks(classes, axes, eps))
    together = lambda c: F.floor(F.col(c) / TOGETHER)
    pairs = written.table(near_blocks(blocks, eps, written).withColumn("task", F.struct("label", "dim", together("a").alias("a"), together("b").alias("b"))).select("task", "a_block", "b_block"))
    # a block is sent once to each task that it has a part in
    ends = pairs.select("task", F.col("a_block").alias("block"), F.col("b_block").alias("other")).unionAll(pairs.select("task", "b_block", F.lit(None).cast("long")))
    sides = ends.groupBy("task", "block").agg(F.collect_list("other").alias("partners"))
    joined = blocks.select("block", "leaf", "rep", "n", "embedding").join(sides, "block")
    found = written.table(joined.groupBy("task").applyInArrow(lambda rows: compare(rows, cosine, axes), "rep long, linked long, root long"))
    joins = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), written)
    linked = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    rooted = classes.select("rep", "least_id").join(joins, classes["rep"] == joins["node"], "left").select("rep", "least_id", F.coalesce("root", "rep").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = classes.join(linked, "rep", "left").join(rooted.join(smallest, "root").select("rep", "component_id"), "rep")
    known = known.select("label", "embedding", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    some = valid.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = vectors.where(~comparable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionAll(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
