"""Collocations: phrases of two to four words that occur together far more often than their parts would let expect.

Texts are cut into pieces at punctuation and line breaks, pieces into words. The words of a language that
occur often enough get dictionary numbers, the most frequent of all languages first; any other word breaks its
piece, as no phrase that holds it can be frequent. Each place of a text where two numbered words meet gives
one key of KEY bytes: the numbers of up to four words from there on, zeros behind the end of the piece.
A task sorts the keys of RUN places by their digits and adds up equal ones; the runs are written in blocks. Splitters
from a sample of the blocks' keys cut all runs into ranges; a range is sorted again in one task, where the counts of all phrases of
two, three and four words are the lengths of the runs of equal prefixes. Only phrases that reach the border of a range
may be counted in several of them, so they are added up afterwards; others are dropped at once when rare.

Splitters only balance the work: SPLITTERS of the keys at most are looked at for them, whatever the number of blocks. The dictionary is
broadcast while it holds at most DICTIONARY_WORDS words and DICTIONARY_BYTES bytes, as counted; beyond, the words of each
chunk of texts are joined with it, and a chunk meets only its own words.

A phrase is scored by its weakest cut: floor(2000000 a / (l + r)) for its own count a and those of both parts.
Phrases inside a longer one that explains 80 per cent of their count are dropped. All arithmetic is of whole numbers; products
are decimals.

Nulls: a null text is an empty one, a null lang is `und` (and counted with texts of that lang). Very long texts are
read whole. Repeated rows count each. Ties in the report go by count, then by phrase. An empty table gives an empty
report. Only lang and text are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlens.llm.common import Written
from pairlens.llm.lm import from_planes, packed, planes, unpacked

WORDS = (2, 3, 4)  # of a phrase
ID, KEY = 4, 16  # bytes of a word's number, and of a key
#: Byte by byte: A-Z in lower case, ends of pieces as line breaks.
TRANSLATE = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d" + bytes(range(65, 91)), b"\n" * 10 + bytes(range(97, 123)))
BREAK = b"\xff"  # in no UTF-8 text
RUN = 1_000_000  # places whose keys are sorted at once
BLOCK = 25_000  # distinct keys of a block
RANGE_KEYS = 600_000  # keys of a range, as written
SAMPLED, SPLITTERS = 1000, 200_000  # keys of a block for each sampled one, and sampled ones at most from which splitters are chosen
DICTIONARY_WORDS, DICTIONARY_BYTES = 500_000, 8_000_000
DISTINCT = 200_000  # words that a task counts before it hands them on
CHUNK_BYTES = 16_000_000  # text of a chunk, where the dictionary is joined
UNKNOWN = "und"
SCALE, INSIDE = 2_000_000, 80


def pieces(text: bytes) -> list[bytes]:
    """Words in order, BREAK between pieces."""
    return text.translate(TRANSLATE).replace(b"\n", b" " + BREAK + b" ").split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n; a null word has the words of all texts of its lang."""
    counts: dict[str, Counter] = defaultdict(Counter)

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            own.pop(BREAK, None)
            words, n = pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(own.values(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), words, n], ["lang", "word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.string()), pa.array([sum(own.values())], pa.int64())], ["lang", "word", "n"])
        counts.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            counts[lang].update(pieces(text.as_py()))
            if sum(map(len, counts.values())) > DISTINCT:
                yield from flushed()
    yield from flushed()


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of keys given by unsigned columns, the last the least: by 16-bit digits from the last on; digits that are all equal are passed over."""
    order = None
    for column in reversed(columns):
        for shift in range(0, 8 * column.itemsize, 16):
            digit = ((column >> column.dtype.type(shift)) & column.dtype.type(0xFFFF)).astype(np.uint16)
            if not len(digit) or digit.min() == digit.max():
                continue
            by = np.argsort(digit if order is None else digit[order], kind="stable")  # a radix sort for 16 bits
            order = by if order is None else order[by]
    return np.arange(len(columns[0])) if order is None else order


def summed(hi: np.ndarray, lo: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    order = radix_order([hi, lo])
    hi, lo = hi[order], lo[order]
    begin = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(hi) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begin, len(hi))) if n is None else np.add.reduceat(n[order], begin) if len(hi) else n
    return hi[begin], lo[begin], counts.astype(np.int64)


def keys(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all places where two numbered words meet, as two columns. ids: 0 where a piece ends."""
    padded = np.append(ids, np.zeros(max(WORDS), ids.dtype)).astype(np.uint64)
    w = [padded[k : k + len(ids)].copy() for k in range(max(WORDS))]
    w[2] *= w[1] > 0
    w[3] *= w[2] > 0
    at = (w[0] > 0) & (w[1] > 0)
    pair = lambda a, b: (a[at] << np.uint64(32)) | b[at]
    return pair(w[0], w[1]), pair(w[2], w[3])


RUNS = "sample binary, n long, hi binary, lo binary, counts binary"
CODEC = pa.Codec("zstd", 1)


def _closed(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted keys and their counts, compressed: the first halves as steps, all byte by byte."""
    return CODEC.compress(planes(np.diff(hi, prepend=np.uint64(0)).astype("<u8")), asbytes=True), CODEC.compress(planes(lo.astype("<u8")), asbytes=True), packed(n)


def _opened(n: int, hi: bytes, lo: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    whole = lambda x: from_planes(CODEC.decompress(x, 8 * n, asbytes=True), "<u8")
    return np.cumsum(whole(hi), dtype=np.uint64), whole(lo), unpacked(counts, n)


def _blocks(ids: list[int]) -> Iterator[pa.RecordBatch]:
    hi, lo, n = summed(*keys(np.array(ids, dtype=np.uint32)))
    for i in range(0, len(hi), BLOCK):
        a, b, c = hi[i : i + BLOCK], lo[i : i + BLOCK], n[i : i + BLOCK]
        at = np.arange(min(SAMPLED, len(a)) // 2, len(a), SAMPLED)
        columns = [pa.array([x]) for x in (np.stack([a[at], b[at]], axis=1).astype(">u8").tobytes(), len(a), *_closed(a, b, c))]
        yield pa.RecordBatch.from_arrays(columns, ["sample", "n", "hi", "lo", "counts"])


class _Runs:
    """Gathers the numbers of words and hands on a sorted run whenever RUN are there."""

    def __init__(self):
        self.ids: list[int] = []

    def add(self, text: bytes, number: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        get = number.get
        self.ids += [get(w, 0) for w in pieces(text)]
        self.ids.append(0)
        if len(self.ids) >= RUN:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        ids, self.ids = self.ids, []
        yield from _blocks(ids)


def _by_broadcast(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    table = dictionary.select("lang", "word", "id").toArrow()  # DICTIONARY_WORDS words and DICTIONARY_BYTES bytes at most
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, dict[bytes, int]] = defaultdict(dict)
        held = sent.value
        for lang, word, i in zip(held.column("lang").to_pylist(), held.column("word").cast(pa.binary()).to_pylist(), held.column("id").to_pylist(), strict=True):
            numbers[lang][word] = i
        runs = _Runs()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                yield from runs.add(text.as_py(), numbers[lang])
        yield from runs.close()

    return rows.mapInArrow(run, RUNS)


def _by_join(rows: DataFrame, dictionary: DataFrame, written: Written) -> DataFrame:
    """The same without a broadcast: each chunk of texts is sent its own words with their numbers."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = 1 + total // CHUNK_BYTES
    dealt = written.table(rows.withColumn("chunk", F.monotonically_increasing_id()).repartition(int(min(chunks, 10_000)), "chunk").withColumn("chunk", F.pmod(F.xxhash64("chunk"), F.lit(chunks))))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, str], set[bytes]] = defaultdict(set)
            for chunk, lang, text in zip(batch.column("chunk").to_pylist(), batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                found[chunk, lang].update(pieces(text.as_py()))
            for (chunk, lang), words in found.items():
                words.discard(BREAK)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(words), pa.int64()), pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()).cast(pa.string())], ["chunk", "lang", "word"])

    asked = dealt.mapInArrow(distinct, "chunk long, lang string, word string").distinct()
    answered = asked.join(dictionary.select("lang", "word", "id"), ["lang", "word"])

    def run(key: tuple, texts: pa.Table, words: pa.Table) -> pa.Table:
        numbers: dict[str, dict[bytes, int]] = defaultdict(dict)
        for lang, word, i in zip(words.column("lang").to_pylist(), words.column("word").cast(pa.binary()).to_pylist(), words.column("id").to_pylist(), strict=True):
            numbers[lang][word] = i
        runs, out = _Runs(), []
        for lang, text in zip(texts.column("lang").to_pylist(), texts.column("text").cast(pa.binary()).to_pylist(), strict=True):
            out += runs.add(text, numbers[lang])
        out += runs.close()
        schema = pa.schema([("sample", pa.binary()), ("n", pa.int64()), ("hi", pa.binary()), ("lo", pa.binary()), ("counts", pa.binary())])
        return pa.Table.from_batches(out, schema)

    return dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(run, RUNS)


def _splitters(runs: DataFrame, ranges: int) -> list[bytes]:
    """Keys that cut all runs into so many ranges of about as many keys."""
    sampled = runs.agg(F.coalesce(F.sum(F.length("sample")), F.lit(0))).first()[0] // KEY
    some = runs if sampled <= SPLITTERS else runs.where(F.pmod(F.xxhash64("sample"), F.lit(sampled)) < SPLITTERS // 2)
    found = sorted(r["sample"][i : i + KEY] for r in some.select("sample").collect() for i in range(0, len(r["sample"]), KEY))  # about SPLITTERS / 2 at most, of KEY bytes
    return sorted({bytes(found[len(found) * k // ranges]) for k in range(1, ranges)}) if found else []


def _two(key: bytes) -> tuple[int, int]:
    return int.from_bytes(key[:8], "big"), int.from_bytes(key[8:], "big")


def _cut(runs: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Blocks cut at the splitters: range, n, hi, lo, counts."""
    cuts = [_two(s) for s in splitters]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        highs = np.array([h for h, _ in cuts], dtype=np.uint64)
        for batch in batches:
            for i in range(batch.num_rows):
                hi, lo, n = _opened(*[batch.column(c)[i].as_py() for c in ("n", "hi", "lo", "counts")])
                least, most = np.searchsorted(highs, hi[0], "left"), np.searchsorted(highs, hi[-1], "right")
                places = [0]
                for h, low in cuts[least:most]:
                    a, b = np.searchsorted(hi, np.uint64(h), "left"), np.searchsorted(hi, np.uint64(h), "right")
                    places.append(int(a + np.searchsorted(lo[a:b], np.uint64(low), "left")))
                places.append(len(hi))
                out = [(int(least) + k, b - a, *_closed(hi[a:b], lo[a:b], n[a:b])) for k, (a, b) in enumerate(zip(places[:-1], places[1:], strict=True)) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["range", "n", "hi", "lo", "counts"])

    return runs.select("n", "hi", "lo", "counts").mapInArrow(run, "range long, n long, hi binary, lo binary, counts binary")


def phrases_of(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, least: int) -> pa.Table:
    """key, n of the phrases that sorted keys begin with: those of least occurrences, and those that may go on in the next ranges."""
    out_keys: list[bytes] = []
    out_counts: list[np.ndarray] = []
    for words in WORDS:
        if words == 2:
            kept, a, b = n, hi, np.zeros_like(lo)
        else:
            b = lo if words == 4 else lo >> np.uint64(32) << np.uint64(32)
            has = (b & np.uint64(0xFFFFFFFF)) > 0 if words == 4 else b > 0
            kept, a, b = n[has], hi[has], b[has]
        if not len(a):
            continue
        begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        count, a, b = np.add.reduceat(kept, begin), a[begin], b[begin]
        good = count >= least
        good[[0, -1]] = True  # of the first and last keys of the range, or dropped later
        packed = np.stack([a[good], b[good]], axis=1).astype(">u8").tobytes()
        out_keys += [packed[i : i + ID * words] for i in range(0, len(packed), KEY)]
        out_counts.append(count[good])
    counts = np.concatenate(out_counts) if out_counts else np.zeros(0, np.int64)
    return pa.table({"key": pa.array(out_keys, pa.binary()), "n": pa.array(counts, pa.int64())})


def dictionary_of(counts: DataFrame, least: int, written: Written) -> DataFrame:
    """lang, word, n, id: words of least occurrences, numbered from 1, the most frequent first."""
    often = counts.where((F.col("n") >= least) & F.col("word").isNotNull())
    # places within the ranges of a sort, and the number of rows before each range: no task sorts or numbers all
    sorted_ = often.repartitionByRange(F.desc("n"), "lang", "word").sortWithinPartitions(F.desc("n"), "lang", "word")
    placed = written.table(sorted_.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # a row a partition
    starts, before = [], 1
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    if before > 1 << 32:
        raise ValueError("more frequent words than numbers of 32 bits")
    start = placed.sparkSession.createDataFrame(starts, "part int, start long")
    return placed.join(F.broadcast(start), "part").select("lang", "word", "n", (F.col("start") + F.col("place")).alias("id"))


def counted_phrases(rows: DataFrame, least: int, written: Written) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (lang, text): dictionary (lang, word, n, id), totals (lang, total), phrases (key, a) of least occurrences."""
    counts = written.table(rows.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") >= least)))
    totals = counts.where("word IS NULL").select("lang", F.col("n").alias("total"))
    dictionary = written.table(dictionary_of(counts, least, written))
    size = dictionary.agg(F.count("*").alias("words"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")).first()
    small = size["words"] <= DICTIONARY_WORDS and size["bytes"] <= DICTIONARY_BYTES
    runs = written.table(_by_broadcast(rows, dictionary) if small else _by_join(rows, dictionary, written))
    held = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least_tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least_tasks, held // RANGE_KEYS)
    cut = _cut(runs, _splitters(runs, ranges)).repartition(ranges, "range")

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        found = [_opened(*[rows.column(c)[i].as_py() for c in ("n", "hi", "lo", "counts")]) for i in range(rows.num_rows)]
        return phrases_of(*summed(*[np.concatenate([x[i] for x in found]) for i in range(3)]), least)

    parts = cut.groupBy("range").applyInArrow(merge, "key binary, n long")
    return dictionary, totals, written.table(parts.groupBy("key").agg(F.sum("n").alias("a")).where(F.col("a") >= least))


def _words(key: str, first: int, n: int) -> Column:
    """The part of a key that holds n words from a place on."""
    return F.substring(key, ID * first + 1, ID * n)


def collocations(docs: DataFrame, per_lang: int = 2000, least: int = 30) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    written = Written(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    dictionary, totals, phrases = counted_phrases(rows, least, written)
    number = F.unhex(F.lpad(F.hex("id"), 2 * ID, "0"))
    single = dictionary.select(number.alias("key"), "lang", "word", "n")
    counts = phrases.select("key", "a").unionAll(single.select("key", F.col("n").alias("a")))
    # every part of a phrase is at least as frequent, so it is there
    cuts = lambda n: F.array(*[F.struct(F.lit(k).alias("k"), _words("key", 0, k).alias("first"), _words("key", k, n - k).alias("rest")) for k in range(1, n)])
    by_length = F.when(F.length("key") == 2 * ID, cuts(2)).when(F.length("key") == 3 * ID, cuts(3)).otherwise(cuts(4))
    parts = phrases.select("key", "a", F.inline(by_length))
    parts = parts.join(counts.toDF("first", "l"), "first").join(counts.toDF("rest", "r"), "rest")
    value = F.expr(f"(CAST(a AS DECIMAL(20,0)) * {SCALE}) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))").cast("long")
    scored = parts.withColumn("score", value).groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = lambda n: F.array(*[_words("key", i, m) for m in WORDS if m < n for i in range(n - m + 1)])
    longer = phrases.where(F.length("key") > 2 * ID).select(F.col("a").alias("outer"), F.explode(F.when(F.length("key") == 3 * ID, inner(3)).otherwise(inner(4))).alias("key"))
    around = longer.groupBy("key").agg(F.max("outer").alias("outer"))
    explained = F.expr(f"CAST(100 AS DECIMAL(20,0)) * outer >= CAST({INSIDE} AS DECIMAL(20,0)) * a")
    kept = scored.join(around, "key", "left").where(F.col("outer").isNull() | ~explained)
    named = kept.join(single.select(F.col("key").alias("head"), "lang"), _words("key", 0, 1) == F.col("head"))
    # whatever ties with the last place is spelled out, then ranked in full
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"))
    best = written.table(named.select("lang", "key", "a", "cut", F.rank().over(order).alias("rank")).where(F.col("rank") <= per_lang))
    places = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), _words("key", i, 1).alias("word_key")) for i in range(max(WORDS))]), lambda x: F.length(x["word_key"]) > 0)
    spelled = best.select("key", F.inline(places)).join(single.select(F.col("key").alias("word_key"), "word"), "word_key")
    texts = spelled.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    full = best.join(texts, "key").join(totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = full.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= per_lang)
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
