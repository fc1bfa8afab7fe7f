"""Scores of a bigram language model by deleted interpolation.

P(w | v) = a2 c(v, w) / c(v) + a1 c(w) / N + a0 / (V + 1); the weights a depend on the bucket of
c(v), the frequency of the context (powers of two), and are learned by expectation-maximisation on
the counts of a held-out part of the training documents, with frequencies from the rest. There,
probabilities are told apart by 1/STEPS of a power of two, so that what the driver sees does not grow
with the corpus; scores move by less than 0.1 per cent through that (tested on sf0.001; 0.07 there, 0.02 on sf0.01).

Words are counted in chunks: a chunk is a row that holds some whole documents as numbers of words,
and the hash of each distinct word. Each chunk sends its distinct words and word pairs, with their
counts, to ranges of hash values; a range adds up what all chunks sent and answers each chunk with
the totals of what it asked. So frequent words and pairs are added up before the shuffle, no table
of the vocabulary is ever broadcast, and all counts cover all documents. Words are told apart by
their 64-bit hashes.

Nulls: a null text is an empty one, with its end as the only token. A null doc_id takes part like
the empty string. Repeated rows are scored and counted each for itself. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import Written

END = b""  # no word is empty
START_HASH = np.uint64(0x9E3779B97F4A7C15)
CHUNK_TOKENS = 150_000
FILE_CHUNKS = 8  # so that no task holds many chunks at once
RANGE_TOKENS = 500_000  # tokens of the corpus for each range of hash values
MIN_RANGES = 64
TASK_TOKENS = 4_000_000  # tokens of the corpus for each task of an exchange
TUNE_ONE_IN = 8  # of the training documents, for the weights
EM_ROUNDS, EM_CHANGE = 1000, 1e-7  # rounds end when no weight moves more
STEPS = 16  # probabilities are told apart by 1/16 of a power of two when weights are learned


def packed(counts: np.ndarray) -> bytes:
    """Counts as a byte each, those of 255 and more after them in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=n) if len(data) > n else 0
    return out


def planes(a: np.ndarray) -> bytes:
    """Unsigned numbers, all their lowest bytes first, then the next ones: what Spark compresses well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def squeezed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as the steps between them."""
    return planes(np.diff(hashes.astype("<u8"), prepend=np.uint64(0)))


def unsqueezed(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, "<u8"), dtype=np.uint64)


def mixed_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in order."""
    x = a * np.uint64(0xBF58476D1CE4E5B9) + (b ^ (b >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _chunk(words: list[bytes]) -> tuple[bytes, bytes]:
    """Each word's number, and the sorted hashes that the numbers stand for."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return planes(place[coded.indices.to_numpy()].astype("<u4")), squeezed(hashes[order])


def chunks(docs: DataFrame, folds: int, held: int) -> DataFrame:
    """A row for each chunk: chunk, tune, doc_id, held, length (lists by document), n_train, ids, hashes."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"chunk long, tune boolean, doc_id array<{kind}>, held array<boolean>, length array<long>, n_train long, ids binary, hashes binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        open_: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}
        id_type = None

        def close(tune: bool) -> pa.RecordBatch:
            nonlocal n
            some, words = open_[tune]
            open_[tune] = ([], [])
            ids, hashes = _chunk(words)
            n += 1
            train = sum(length for _, held_out, length in some if not held_out)
            columns = [
                pa.array([part << 32 | n], pa.int64()), pa.array([tune]), pa.array([[d for d, _, _ in some]], pa.list_(id_type)), pa.array([[h for _, h, _ in some]], pa.list_(pa.bool_())),
                pa.array([[k for _, _, k in some]], pa.list_(pa.int64())), pa.array([train], pa.int64()), pa.array([ids], pa.binary()), pa.array([hashes], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "tune", "doc_id", "held", "length", "n_train", "ids", "hashes"])

        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text, held_out, tune in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                some, words = open_[tune]
                own = (text.as_py() or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
                own.append(END)
                words += own
                some.append((doc_id, held_out, len(own)))
                if len(words) >= CHUNK_TOKENS:
                    yield close(tune)
        for tune, (some, _) in list(open_.items()):
            if some:
                yield close(tune)

    code = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    held_out = F.pmod(code, F.lit(folds)) == held
    # by text, so that copies are on one side, and null or repeated ids do not matter
    tune = ~held_out & (F.pmod(F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")), F.lit(TUNE_ONE_IN)) == 0)
    return docs.select("doc_id", "text", held_out.alias("held"), tune.alias("tune")).mapInArrow(build, schema)


class Pairs:
    """The distinct words and word pairs of a chunk, each sorted by hash, and where each token finds its own."""

    def __init__(self, ids: bytes, hashes: bytes, lengths: np.ndarray):
        self.ids = from_planes(ids, "<u4").astype(np.int64)
        self.words = unsqueezed(hashes)
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        self.before = np.empty_like(self.ids)
        self.before[1:] = self.ids[:-1]
        self.before[self.begins] = len(self.words)
        distinct, self.pair = np.unique(self.before * len(self.words) + self.ids, return_inverse=True)
        with_start = np.append(self.words, START_HASH)
        pairs = mixed_hash(with_start[distinct // len(self.words)], self.words[distinct % len(self.words)])
        order = np.argsort(pairs, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.pairs, self.pair = pairs[order], place[self.pair]


def _cuts(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of sorted hashes that are not empty, and where each begins and, at last, the end."""
    which = ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    return which[begin], np.append(begin, len(hashes))


def _of(batch: pa.RecordBatch | pa.Table, name: str, row: int):
    return batch.column(name)[row].as_py()


def questions(table: DataFrame, word_ranges: int, pair_ranges: int) -> DataFrame:
    """range, chunk, tune, hashes, counts (in training documents): words in the first ranges, pairs in the rest."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = np.array(_of(batch, "length", i), dtype=np.int64)
                p = Pairs(_of(batch, "ids", i), _of(batch, "hashes", i), lengths)
                train = np.repeat(~np.array(_of(batch, "held", i), dtype=bool), lengths)
                rows: list[tuple] = []
                for hashes, token, ranges, first in ((p.words, p.ids, word_ranges, 0), (p.pairs, p.pair, pair_ranges, word_ranges)):
                    counts = np.bincount(token[train], minlength=len(hashes))
                    which, cut = _cuts(hashes, ranges)
                    rows += [(first + int(w), squeezed(hashes[a:b]), packed(counts[a:b])) for w, a, b in zip(which, cut[:-1], cut[1:], strict=True)]
                n = len(rows)
                columns = [
                    pa.array([r for r, _, _ in rows], pa.int64()), pa.array([_of(batch, "chunk", i)] * n, pa.int64()), pa.array([_of(batch, "tune", i)] * n, pa.bool_()),
                    pa.array([h for _, h, _ in rows], pa.binary()), pa.array([c for _, _, c in rows], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["range", "chunk", "tune", "hashes", "counts"])

    return table.mapInArrow(ask, "range long, chunk long, tune boolean, hashes binary, counts binary")


ANSWER = "range long, chunk long, tune boolean, totals binary, rest binary, known long"


def _answer(asked: pa.Table) -> pa.Table:
    """Totals of one range for each chunk: over all training documents, and (for chunks of the tuning part) over the rest of them."""
    asked = asked.sort_by("chunk")
    tune = np.array(asked.column("tune").to_pylist(), dtype=bool)
    hashes = [unsqueezed(h) for h in asked.column("hashes").to_pylist()]
    counts = [unpacked(c, len(h)) for c, h in zip(asked.column("counts").to_pylist(), hashes, strict=True)]
    distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
    ends = np.cumsum([len(h) for h in hashes])
    totals, tuned = np.zeros(len(distinct), dtype=np.int64), np.zeros(len(distinct), dtype=np.int64)
    for c, t, end in zip(counts, tune, ends, strict=True):  # a chunk names a hash once
        own = at[end - len(c) : end]
        totals[own] += c
        if t:
            tuned[own] += c
    out_totals, out_rest = [], []
    for c, t, end in zip(counts, tune, ends, strict=True):
        own = at[end - len(c) : end]
        out_totals.append(packed(totals[own]))
        out_rest.append(packed((totals - tuned)[own]) if t else None)
    known = [int((totals > 0).sum())] + [0] * (len(counts) - 1)
    return pa.table({"range": asked.column("range"), "chunk": asked.column("chunk"), "tune": asked.column("tune"), "totals": pa.array(out_totals, pa.binary()), "rest": pa.array(out_rest, pa.binary()), "known": pa.array(known, pa.int64())})


class Counted:
    """A chunk with the counts that its words and pairs have in the corpus."""

    def __init__(self, chunk: pa.Table, answers: pa.Table, word_ranges: int, pair_ranges: int, column: str):
        self.lengths = np.array(_of(chunk, "length", 0), dtype=np.int64)
        self.p = Pairs(_of(chunk, "ids", 0), _of(chunk, "hashes", 0), self.lengths)
        answers = dict(zip(answers.column("range").to_pylist(), answers.column(column).to_pylist(), strict=True))
        found = []
        for hashes, ranges, first in ((self.p.words, word_ranges, 0), (self.p.pairs, pair_ranges, word_ranges)):
            which, cut = _cuts(hashes, ranges)
            found.append(np.concatenate([unpacked(answers[first + int(w)], int(b - a)) for w, a, b in zip(which, cut[:-1], cut[1:], strict=True)]))
        self.words, pairs = found
        end = np.searchsorted(self.p.words, np.uint64(xxhash.xxh64_intdigest(END)))
        context = np.append(self.words, self.words[end])  # as many starts as ends
        self.word, self.pair, self.context = self.words[self.p.ids], pairs[self.p.pair], context[self.p.before]


def buckets(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + floor(log2)."""
    return np.frexp(context.astype(float))[1].astype(np.int64)


def _share(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    return a / np.maximum(b, 1)


def learn_weights(bucket: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, n: np.ndarray) -> np.ndarray:
    """Weights (a2, a1, a0) by bucket, by expectation-maximisation; a bucket starts from, and leans a little on, those of all buckets."""

    def em(which: np.ndarray, size: int, start: np.ndarray, lean: float) -> np.ndarray:
        a = np.repeat(start[None], size, axis=0)
        p = np.stack([p2, p1, np.full(len(p2), p0)], axis=1)
        for _ in range(EM_ROUNDS):
            before = a
            part = a[which] * p
            part *= (n / np.maximum(part.sum(axis=1), 1e-300))[:, None]
            got = np.stack([np.bincount(which, part[:, k], minlength=size) for k in range(3)], axis=1) + lean * start
            a = got / got.sum(axis=1, keepdims=True)
            if np.abs(a - before).max() < EM_CHANGE:
                break
        return a

    start = np.array([0.5, 0.4, 0.1])
    # where nothing was held out, or nothing else is left to count, the first weights stay
    some = len(n) > 0 and (p1 > 0).any()
    if some:
        start = em(np.zeros(len(n), dtype=np.int64), 1, start, 1.0)[0]
    a = em(bucket, 65, start, 1.0) if some else np.repeat(start[None], 65, axis=0)
    a[0] = [0, a[0, 1] + a[0, 2] * (a[0, 1] == 0), a[0, 2]]  # an unseen context has no pairs
    a = np.maximum(a, [0, 1e-6, 1e-6])
    return a / a.sum(axis=1, keepdims=True)


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    written = Written(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    table = written.table(chunks(docs.select("doc_id", "text"), folds, held), FILE_CHUNKS)
    sums = table.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("tune"), F.col("n_train"))), F.lit(0)).alias("tuned"), F.coalesce(F.sum(F.aggregate("length", F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0)).alias("all")).first()
    train, rest = sums["n"], sums["n"] - sums["tuned"]
    pair_ranges = max(MIN_RANGES, sums["all"] // RANGE_TOKENS)
    word_ranges = max(MIN_RANGES // 2, pair_ranges // 8)
    # tasks grow with the corpus, so that none does
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), sums["all"] // TASK_TOKENS)
    asked = questions(table, word_ranges, pair_ranges).repartition(tasks, "range")
    answers = written.table(asked.groupBy("range").applyInArrow(_answer, ANSWER))
    known = answers.where(F.col("range") < word_ranges).agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    uniform = 1 / (known + 1)

    def tally(key: tuple, chunk: pa.Table, replies: pa.Table) -> pa.Table:
        c = Counted(chunk, replies, word_ranges, pair_ranges, "rest")
        quantum = lambda p: np.where(p > 0, np.floor(-np.log2(np.maximum(p, 1e-300)) * STEPS), -1).astype(np.int64)
        bucket, q2, q1 = buckets(c.context), quantum(_share(c.pair, c.context)), quantum(_share(c.word, rest))
        rows, n = np.unique(np.stack([bucket, q2, q1]), axis=1, return_counts=True)
        return pa.table({"bucket": rows[0], "q2": rows[1], "q1": rows[2], "n": n.astype(np.int64)})

    dealt = lambda df: df.repartition(tasks, "chunk").groupBy("chunk")
    tuning = dealt(table.where("tune")).cogroup(dealt(answers.where("tune")))
    # a row for each bucket and two rounded probabilities: their number does not grow with the corpus
    rows = tuning.applyInArrow(tally, "bucket long, q2 long, q1 long, n long").groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).toPandas().sort_values(["bucket", "q2", "q1"])
    real = lambda q: np.where(q >= 0, 2.0 ** -((q + 0.5) / STEPS), 0.0)
    weights = learn_weights(rows["bucket"].to_numpy(np.int64), real(rows["q2"].to_numpy(np.int64)), real(rows["q1"].to_numpy(np.int64)), uniform, rows["n"].to_numpy(float))

    def score(key: tuple, chunk: pa.Table, replies: pa.Table) -> pa.Table:
        c = Counted(chunk, replies, word_ranges, pair_ranges, "totals")
        a = weights[buckets(c.context)]
        p = a[:, 0] * _share(c.pair, c.context) + a[:, 1] * _share(c.word, train) + a[:, 2] * uniform
        base = np.log10((c.word + 1) / (train + known + 1))
        add = lambda x: np.add.reduceat(x, c.p.begins)
        lengths = c.lengths
        return pa.table({
            "doc_id": chunk.column("doc_id").combine_chunks().flatten(), "held_out": chunk.column("held").combine_chunks().flatten(), "n_tokens": lengths,
            "n_known": add((c.word > 0).astype(np.int64)), "train_tokens": np.full(len(lengths), train, dtype=np.int64), "base_score": add(base), "score": add(np.log10(p)),
        })

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt(table).cogroup(dealt(answers)).applyInArrow(score, schema)
