"""One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

SimHash proposes first: fingerprints over five-word shingles are joined by the binary trie. A pair
of similarity 0.8 differs in some ten of 64 bits, though, where no trie can prune, so MinHash bands
propose the rest. Texts that agree in one of BANDS bands meet in a group. A group of at most FEW
texts gives all its likely pairs by the signatures. A larger one of at most GROUP texts is compared
in one task, which confirms likely pairs of texts that no confirmed pair links yet.

In a group larger still, each text is held against the smallest, its pivot. Those similar to the
pivot leave the group, as they are linked already. One of them can only be similar to a text that
is within twice the distance of the pivot (Jaccard distance is a metric), so they are compared with
those texts, the ring, in blocks of GROUP. All that is left is cut by further bands; what is still
large after LEVELS cuts is compared block by block. So near copies make no pairs with the square of
their number, and no group drops a likely pair: every one is confirmed by the exact Jaccard
similarity of the two whole texts, or its texts are linked by others.

A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8 ** 4) ** 15 = 0.9996, its
estimate is below DOUBT once in twenty thousand, and it shares a cut of a large group that holds
both and no similar pivot with probability 1 - (1 - 0.8 ** 3) ** 8 = 0.997.

Nulls: a null text counts as an empty one, and empty texts as copies of each other. A text with
fewer than five words is one shingle. Repeated rows and rows with null or repeated ids are told apart
by their place in a written table. An empty table gives an empty result. Only doc_id and text are
read; other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import Written, components, document, restored
from pairlens.llm.simhash import SEED, links, majority

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 15, 4  # hashes of a band
MORE_BANDS, MORE_ROWS = 8, 3  # of each cut of a large group
LEVELS = 2  # cuts of a large group
GROUP = 1024  # texts of a group that one task compares
FEW = 24  # texts of a group that gives all its likely pairs
RING = 0.41  # estimated similarity to a pivot from which texts may be similar to those similar to it: four standard errors below 1 - 2 * (1 - SIMILARITY)
DOUBT = 0.65  # estimated similarity from which texts are compared: four standard errors below SIMILARITY
CHUNK = 1 << 10  # shingles hashed at once
HELD = 4_000_000  # shingles of texts that a task keeps while it confirms pairs, or of a group or block that confirms its own
_rng = np.random.default_rng(SEED)
HASHES = ROWS * BANDS + LEVELS * MORE_ROWS * MORE_BANDS
FACTORS, SHIFTS = (_rng.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None] for _ in range(2))
FACTORS |= np.uint32(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only


def shingles(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the runs of SHINGLE words, in order, repeats included."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(words))
    out = np.full(len(words) - width + 1, len(words) < SHINGLE, dtype=np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + len(out)]) * STEP
        out ^= out >> np.uint64(29)
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least of each of HASHES hashes over all shingles."""
    least = np.full(HASHES, 2**32 - 1, dtype=np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), CHUNK):
        mixed = FACTORS * high[i : i + CHUNK]
        mixed += SHIFTS
        least = np.minimum(least, mixed.min(axis=1))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """Keys of all bands, those of the first groups first."""
    cut = ROWS * BANDS
    parts = [*least[:cut].reshape(-1, ROWS), *least[cut:].reshape(-1, MORE_ROWS)]
    return np.fromiter((xxhash.xxh64_intdigest(p.tobytes(), i) for i, p in enumerate(parts)), dtype=np.uint64, count=len(parts)).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        norms, prints, sizes, marks, keys = [], [], [], [], []
        for text in batch.column("text"):
            words = words_of(text.as_py())
            found = shingles(words) if words else np.zeros(1, dtype=np.uint64)
            distinct = np.unique(found)
            least = signature(distinct)
            sizes.append(len(distinct))
            norms.append(hashlib.md5(b" ".join(words)).digest())
            prints.append(majority(found))
            marks.append((least & np.uint32(255)).astype(np.uint8).tobytes())  # low bits: the high ones of a minimum are 0 in long texts
            keys.append(bands(least))
        fps = np.array(prints, dtype=np.uint64).view(np.int64)
        columns = [batch.column("node"), batch.column("doc_id"), batch.column("digest"), pa.array(norms, pa.binary()), pa.array(fps), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["node", "doc_id", "digest", "norm", "fp", "size", "marks", "keys"])


def _estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarities estimated from rows of marks; marks agree once in 256 by chance."""
    return _estimate((x == y).sum(axis=-1, dtype=np.uint8))


def _estimate(agreed: np.ndarray) -> np.ndarray:
    return (agreed / HASHES - 1 / 256) / (1 - 1 / 256)


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether numbers of distinct shingles allow the similarity."""
    return np.minimum(x, y) >= SIMILARITY * np.maximum(x, y)


def _marks(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _near_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of a pivot and a text, those in its ring or nearer, and whether they may be similar."""
    for batch in batches:
        x, y = batch.column("a_size").to_numpy(), batch.column("b_size").to_numpy()
        found = _estimates(_marks(batch.column("a_marks")), _marks(batch.column("b_marks")))
        ring = (found >= RING) & (np.minimum(x, y) >= SIMILARITY**2 * np.maximum(x, y))
        likely = pa.array(ring & (found >= DOUBT) & _alike(x, y))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), likely], ["a", "b", "likely"]).filter(pa.array(ring))


def in_group(rows: pa.Table) -> pa.Table:
    """All likely pairs of a group of few texts."""
    rows = rows.sort_by("node")
    node, size, marks = rows.column("node").to_numpy(), rows.column("size").to_numpy(), _marks(rows.column("marks"))
    i, j = np.triu_indices(len(node), 1)
    near = (_estimates(marks[i], marks[j]) >= DOUBT) & _alike(size[i], size[j])
    return pa.table({"a": node[i[near]], "b": node[j[near]]})


def _set_of(text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.unique(shingles(words)) if words else np.zeros(1, dtype=np.uint64)


def similar(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sorted sets of shingles have the similarity."""
    if not _alike(len(p), len(q)):
        return False
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    shared = int((q[at] == p).sum())
    return shared >= SIMILARITY * (len(p) + len(q) - shared)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: dict[int, np.ndarray] = {}  # of the texts met last
    held = 0

    def set_of(node: int, text: pa.Scalar) -> np.ndarray:
        nonlocal held
        found = sets.get(node)
        if found is None:
            if held > HELD:
                sets.clear()
                held = 0
            found = sets[node] = _set_of(text.as_py())
            held += len(found)
        return found

    for batch in batches:
        sides = [(batch.column(s).to_pylist(), batch.column(f"{s}_text")) for s in "ab"]
        near = [similar(set_of(a, x), set_of(b, y)) for a, x, b, y in zip(*sides[0], *sides[1], strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def in_crowd(rows: pa.Table) -> pa.Table:
    """Links among the texts of a group, enough to connect all that likely pairs connect; or between two sides of it.

    linked: texts of the first side that others link already.
    """
    rows = rows.sort_by([("right", "ascending"), ("node", "ascending")])
    node, size = rows.column("node").to_numpy(), rows.column("size").to_numpy()
    marks = np.ascontiguousarray(_marks(rows.column("marks")).T)  # a row for each hash: long rows compare fast
    text, n = rows.column("text"), len(node)
    right = np.array(rows.column("right").to_pylist(), dtype=bool)
    lefts = int((~right).sum())
    group = np.where(np.array(rows.column("linked").to_pylist(), dtype=bool), -1, np.arange(n))  # texts linked so far
    sets = [_set_of(t.as_py()) for t in text]
    starts = np.cumsum([0, *map(len, sets)])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.zeros(flat.max() + 1, dtype=np.int32)  # whether a shingle is in the text at hand
    a, b = [], []
    for i in range(lefts if right.any() else 1, n):
        before = min(i, lefts)
        near = _estimate((marks[:, :before] == marks[:, i : i + 1]).sum(axis=0, dtype=np.uint8))
        held = np.flatnonzero((near >= DOUBT) & _alike(size[:before], size[i]))
        if not len(held):
            continue
        best = int(held[np.argmax(near[held])])
        linked = [best] if similar(sets[best], sets[i]) else []
        if not linked or (group[held] != group[best]).any():  # the others may link it to further groups
            mine = flat[starts[i] : starts[i + 1]]
            own[mine] = 1
            shared = np.add.reduceat(own[flat[: starts[before]]], starts[:before])[held]
            own[mine] = 0
            linked += held[shared >= SIMILARITY * (size[held] + size[i] - shared)].tolist()
        for j in linked:
            if group[j] != group[i]:
                a.append(node[j])
                b.append(node[i])
                group[group == group[i]] = group[j]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _beside(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    side = lambda s: table.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def by_fingerprint(reps: DataFrame, written: Written) -> DataFrame:
    """Pairs (a, b) of nodes: of each component of fingerprints the trie links, each node with the least one."""
    prints = written.table(reps.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")))
    joined = components(links(prints.select("fp"), written), written)
    rooted = prints.join(joined, prints["fp"] == joined["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n")
    groups = rooted.groupBy("root").agg(F.min("least").alias("a"), F.sum("n").alias("n")).where("n > 1")
    named = rooted.join(groups.select("root", "a"), "root").select("fp", "a")
    return reps.join(named, "fp").select("a", F.col("node").alias("b")).where("a < b")


def _blocks(n: str, total: str) -> Column:
    """How many blocks hold so many texts with so many shingles."""
    return F.greatest(F.ceil(F.col(n) / GROUP), F.ceil(F.col(total) / HELD)).cast("int")


def _compared(rows: DataFrame, texts: DataFrame, tasks: int) -> DataFrame:
    """Confirmed links (a, b) inside groups. rows: (key, node, size, marks, right, linked), a key's texts few enough for a task."""
    # by a number of tasks: few bytes may be much work, so small partitions are not to be merged
    return rows.join(texts, "node").repartition(tasks, "key").groupBy("key").applyInArrow(in_crowd, "a long, b long")


def with_ring(near: DataFrame, similar_to: DataFrame, reps: DataFrame) -> DataFrame:
    """Of each pivot a, blocks of texts similar to it against blocks of those in its ring, as _compared takes them."""
    inner = similar_to.select("a", F.col("b").alias("node"))
    outer = near.join(similar_to, ["a", "b"], "left_anti").select("a", F.col("b").alias("node"))
    sized = inner.withColumn("right", F.lit(False)).unionAll(outer.withColumn("right", F.lit(True))).join(reps.select("node", "size", "marks"), "node")
    count = lambda side, s: [F.count_if(side).alias(f"n_{s}"), F.coalesce(F.sum(F.when(side, F.col("size"))), F.lit(0)).alias(f"t_{s}")]
    counts = sized.groupBy("a").agg(*count(~F.col("right"), "l"), *count(F.col("right"), "r")).where("n_l > 0 AND n_r > 0")
    both = sized.join(counts.select("a", _blocks("n_l", "t_l").alias("l"), _blocks("n_r", "t_r").alias("r")), "a")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("right"), F.col("r")).otherwise(F.col("l")))
    both = both.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("right"), F.col("l")).otherwise(F.col("r")) - 1)))
    ends = [F.when(F.col("right"), F.col(x)).otherwise(F.col(y)) for x, y in (("other", "own"), ("own", "other"))]
    return both.select(F.xxhash64("a", *ends).alias("key"), "node", "size", "marks", "right", (~F.col("right")).alias("linked"))


def in_pieces(rest: DataFrame) -> DataFrame:
    """Groups too large for a task as pairs of blocks, as _compared takes them."""
    sizes = rest.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    cut = rest.join(sizes.select("key", _blocks("n", "total").alias("k")), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    key = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return cut.select(key.alias("key"), "node", "size", "marks", (F.col("own") > F.col("other")).alias("right"), F.lit(False).alias("linked"))


def banded_pairs(reps: DataFrame, texts: DataFrame, written: Written) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes that share a band: likely similar ones, and confirmed ones; enough to link all that the groups hold.

    Groups of more than FEW texts get the texts and confirm their pairs themselves, so that pairs of a crowd never
    leave its task. reps: (node, size, marks, keys), texts: (node, text).
    """
    columns = ["node", "size", "marks", "keys", "key"]
    member = reps.select("node", "size", "marks", "keys", F.explode(F.slice("keys", 1, BANDS)).alias("key"))
    tasks = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    likely, sure = [], []
    for level in range(LEVELS + 1):
        sizes = member.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.sum("size").alias("total")).where("n > 1")
        kind = F.when(F.col("n") <= FEW, "few").when((F.col("n") <= GROUP) & (F.col("total") <= HELD), "crowd").otherwise("large")
        sized = written.table(member.join(sizes, "key").withColumn("kind", kind))
        likely.append(sized.where("kind = 'few'").select("key", "node", "size", "marks").groupBy("key").applyInArrow(in_group, "a long, b long"))
        crowds = sized.where("kind = 'crowd'").select("key", "node", "size", "marks", F.lit(False).alias("right"), F.lit(False).alias("linked"))
        sure.append(_compared(crowds, texts, tasks))
        large = sized.where("kind = 'large' AND node <> least")
        if large.isEmpty():
            break
        stars = large.select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
        near = written.table(_beside(stars, reps, "size", "marks").mapInArrow(_near_pivots, "a long, b long, likely boolean"))
        similar_to = written.table(_beside(near.where("likely").select("a", "b"), texts, "text").mapInArrow(_confirm, "a long, b long"))
        sure += [similar_to, _compared(with_ring(near, similar_to, reps), texts, tasks)]
        rest = large.join(similar_to, (large["least"] == similar_to["a"]) & (large["node"] == similar_to["b"]), "left_anti").select(*columns)
        if level == LEVELS:
            sure.append(_compared(in_pieces(rest), texts, tasks))
        else:
            cuts = rest.withColumn("cut", F.explode(F.slice("keys", BANDS + level * MORE_BANDS + 1, MORE_BANDS)))
            member = written.table(cuts.withColumn("key", F.xxhash64("key", "cut")).select(*columns))
    return reduce(DataFrame.unionAll, likely), reduce(DataFrame.unionAll, sure)


def similar_pairs(reps: DataFrame, texts: DataFrame, written: Written) -> DataFrame:
    """Confirmed pairs (a, b) of nodes. reps: (node, fp, size, marks, keys), texts: (node, text)."""
    likely, sure = banded_pairs(reps, texts, written)
    pairs = written.table(by_fingerprint(reps, written).unionAll(likely).distinct())
    return _beside(pairs, texts, "text").mapInArrow(_confirm, "a long, b long").unionAll(sure)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, with the columns of docs: that of the smallest doc_id (null last)."""
    written = Written(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = written.table(docs.select(document(docs), F.monotonically_increasing_id().alias("node")))
    texts = rows.select("node", "document.text")
    signed = rows.select("node", "document.doc_id", "document.text", F.unhex(F.md5("document.text")).alias("digest"))
    signed = written.table(signed.mapInArrow(_signatures, f"node long, doc_id {kind}, digest binary, norm binary, fp long, size long, marks binary, keys array<bigint>"))
    # by doc_id, those without one last, then by text
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest", "node")
    firsts = signed.groupBy("norm").agg(F.min(first).alias("first")).select("first", F.col("first.node").alias("node"))
    reps = written.table(signed.select("node", "fp", "size", "marks", "keys").join(firsts, "node"))
    joined = components(similar_pairs(reps, texts, written), written)
    rooted = reps.select("node", "first").join(joined.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    chosen = rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.node").alias("node"))
    kept = rows.join(chosen, "node", "left_semi")
    return restored(kept, docs)
