"""Toxicity of texts: logistic regression over hashed words, word pairs and skip-grams, fitted by FTRL-proximal.

Each coordinate has its own rate, alpha / (beta + sqrt(sum of squared gradients)), and its weight stays exactly zero
until its gradients have added up to more than L1. So of SLOTS weights few remain, which are broadcast. A
feature counts once a text, however often and wherever it stands; texts are read whole.

The model is fitted on a bounded sample of labelled training rows: about SAMPLE_ROWS rows and SAMPLE_BYTES bytes of
text at most, drawn by a hash of the text. Equal texts are one example, with the mean of their labels, so copies
neither swell the sample nor stand on its both sides. Features are made in parallel; the examples, at
most SAMPLE_ROWS lists of slots, are then passed EPOCHS times in one task, as each step starts from the last.

Words are runs of letters, digits and underscores, in lower case. Nulls: a null text is an empty one; it
gets the score of a text without known features. Rows with a null doc_id have no label. Rows of labels with a null
doc_id or toxic are not used; several labels of one doc_id are averaged. Without any label all scores are 0.
Repeated rows are scored each; an empty table gives an empty result. Only doc_id and text, and doc_id and
toxic of the labels, are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.langid import remainder

SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 60_000_000
BITS = 20
SLOTS = 1 << BITS
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
EPOCHS = 5
THRESHOLD = 0.7
WORD = re.compile(r"\w+")
WORDS_AT_ONCE = 500_000
KNOWN_WORDS = 500_000  # hashes of words that a task remembers
STEP = np.uint64(0x9E3779B97F4A7C15)
OFFSETS = np.arange(3, dtype=np.uint64) * STEP


class Features:
    """Slots of texts; remembers the hashes of words."""

    def __init__(self):
        self.hashes: dict[str, int] = {}

    def _hashed(self, words: list[str]) -> np.ndarray:
        known = self.hashes
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    def of(self, text: str | None) -> np.ndarray:
        """Distinct slots in order."""
        words = WORD.findall((text or "").lower())
        found = []
        for i in range(0, len(words), WORDS_AT_ONCE):
            h = self._hashed(words[i : i + WORDS_AT_ONCE + 2])  # two more, so that no pair is cut
            slots = [h * STEP]
            for gap in (1, 2):  # pairs, and pairs with a word between
                mixed = (h[:-gap] * np.uint64(0xBF58476D1CE4E5B9) ^ (h[gap:] + OFFSETS[gap])) * np.uint64(0x94D049BB133111EB)
                slots.append((mixed ^ (mixed >> np.uint64(31))) * STEP)
            found.append(np.unique((np.concatenate(slots) >> np.uint64(64 - BITS)).astype(np.int32)))
        return found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def fit(examples: list[tuple[np.ndarray, float]], seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots with a weight, their weights, and the bias. examples: slots and label (0 to 1)."""
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)
    bias_z = bias_n = 0.0

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def bias() -> float:
        return -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            slots, y = examples[i]
            zi, ni, b = z[slots], n[slots], bias()
            w = weights(zi, ni)
            g = _logistic(w.sum() + b) - y
            grown = ni + g * g
            z[slots] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
            n[slots] = grown
            grown = bias_n + g * g
            bias_z += g - (np.sqrt(grown) - np.sqrt(bias_n)) / ALPHA * b
            bias_n = grown
    w = weights(z, n)
    kept = np.flatnonzero(w)
    return kept.astype(np.int32), w[kept].astype(np.float32), float(bias())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        slots = [features.of(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("label"), pa.array(slots, pa.binary())], ["digest", "label", "slots"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples = [(np.frombuffer(s, np.int32), y) for b in batches for s, y in zip(b.column("slots").to_pylist(), b.column("label").to_pylist(), strict=True)]
    if examples:
        slots, weights, bias = fit(examples)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1), pa.int32()), pa.array(np.append(weights, bias), pa.float64())], ["slot", "weight"])


def sample(docs: DataFrame, labels: DataFrame, folds: int, held: int, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> DataFrame | None:
    """digest, label, slots: the drawn examples, a row for each distinct text; none where nothing is labelled."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("label"))
    text = F.coalesce(F.col("text"), F.lit(""))
    training = docs.where(remainder(folds) != held).select("doc_id", text.alias("text"))
    seen = training.select("doc_id", F.octet_length("text").alias("bytes")).join(marks, "doc_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    if not seen["n"]:
        return None
    share = min(1.0, rows / seen["n"], size / max(1, seen["bytes"]))
    drawn = training.withColumn("digest", F.md5("text")).where(F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    once = drawn.join(marks, "doc_id").groupBy("digest").agg(F.min("text").alias("text"), F.avg("label").alias("label"))
    return once.mapInArrow(_features, "digest string, label double, slots binary")


def learned(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Slots, weights and bias, fitted on a sample of the labelled training rows."""
    examples = sample(docs, labels, folds, held)
    if examples is None:
        return None
    model = examples.repartition(1).sortWithinPartitions("digest").mapInArrow(_train, "slot int, weight double").toArrow()  # about SAMPLE_ROWS rows in; SLOTS at most, and the bias, out
    slots, weights = model.column("slot").to_numpy(), model.column("weight").to_numpy()
    return (slots[:-1], weights[:-1].astype(np.float32), float(weights[-1])) if len(slots) else None


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = learned(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), folds, held)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS weights at most
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights, bias = Features(), np.zeros(SLOTS, np.float32), None
        if sent.value is not None:
            slots, some, bias = sent.value
            weights[slots] = some
        for batch in batches:
            scores = [0.0 if bias is None else _logistic(float(weights[features.of(t.as_py())].sum(dtype=np.float64)) + bias) for t in batch.column("text")]
            predicted = pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), predicted], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (remainder(folds) == held).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
