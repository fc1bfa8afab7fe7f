"""Language identification with a linear-chain conditional random field over the words of a text.

A word's features are its byte n-grams with its borders (so prefixes and suffixes too), hashed, and
the languages in whose lexicon it stands. The chain's states are languages; learned transitions say
how seldom a text switches. Forward-backward gives each word of a code-switched text its language;
a text's language is the one with the largest sum of its words' probabilities.

The model is fitted on a bounded sample: SAMPLE_ROWS labelled training rows at most, dealt evenly to
languages, whole texts, drawn by a hash of doc_id and text. Rows of equal id and text are drawn once,
and each language's draw ends at its share, so null or repeated ids neither empty nor swell it.
Training chains are spliced from rows of several languages, so that transitions are learned from
switches. Prediction covers whole texts of all rows.

Words are runs of letters with their combining marks. Nulls: a null text, or one without a letter,
is `und` with score 0; so is every text when there is nothing to learn from. Rows without lang are
predicted, not learned from. Ties go to the language that comes first by code point. Repeated rows
and an empty table are nothing special; only doc_id, text and lang are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE_ROWS = 6000
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ASCII_WORD = re.compile("[a-z]+")
GRAMS = (1, 2, 3, 4)
SLOTS = 1 << 17  # of hashed features; one more stays zero
CHAINS, LENGTH = 3000, 64
SEGMENT = (4, 40)  # words of one language in a training chain
LEXICON_COUNT = 2
EPOCHS, BATCH, RATE = 4, 100, 0.3
BATCH_WORDS = 500_000
UNKNOWN = "und"


def words(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    return ASCII_WORD.findall(low) if low.isascii() else WORD.findall(low)


def grams(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams (a row for each n, a column for each byte of the words and a space before each), and where words begin."""
    data = np.frombuffer((" " + " ".join(distinct) + "    ").encode(), np.uint8).astype(np.uint64)
    size = len(data) - 3  # the words and the space that ends them
    space = data == 32
    out = np.full((len(GRAMS), size - 1), SLOTS, dtype=np.int64)
    code = np.zeros(size - 1, dtype=np.uint64)
    inside = np.ones(size - 1, dtype=bool)  # no border within
    for n in range(1, max(GRAMS) + 1):
        code = code * np.uint64(257) + data[n - 1 : n - 1 + size - 1] + np.uint64(1)
        if n > 2:
            inside &= ~space[n - 2 : n - 2 + size - 1]
        if n in GRAMS:
            mixed = (code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
            good = inside if n > 1 else ~space[: size - 1]
            row = GRAMS.index(n)
            out[row, good] = (mixed[good] >> np.uint64(64 - 17)).astype(np.int64)
    return out, np.flatnonzero(space[: size - 1])


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # slot, language
    lexicon: list[str]
    stands: np.ndarray  # word of the lexicon, language: 1 where it stands in that language's; a last row of zeros
    lexical: np.ndarray  # language of the lexicon, language
    moves: np.ndarray  # log scores of transitions
    first: np.ndarray

    def in_lexicon(self, distinct: pa.Array) -> np.ndarray:
        at = pc.index_in(distinct, pa.array(self.lexicon, pa.string())).to_numpy(zero_copy_only=False)
        return self.stands[np.where(np.isnan(at), len(self.lexicon), at).astype(np.int64)]

    def emissions(self, distinct: pa.Array) -> np.ndarray:
        slots, begin = grams(distinct.to_pylist())
        total = self.in_lexicon(distinct) @ self.lexical
        for row in slots:
            total += np.add.reduceat(self.weights[row], begin, axis=0)
        return total


def _scaled(e: np.ndarray) -> np.ndarray:
    return np.exp(e - e.max(axis=1, keepdims=True))


def posteriors(e: np.ndarray, moves: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Forward-backward for chains laid one after another: each word's probabilities of languages."""
    e, t = _scaled(e), np.exp(moves)
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    lengths = lengths[order]
    # chains longer than step t are the first active[t]
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    forward = np.empty_like(e)
    for step, k in enumerate(active):
        at = begin[:k] + step
        a = e[at] * (np.exp(first) if step == 0 else forward[at - 1] @ t)
        forward[at] = a / a.sum(axis=1, keepdims=True)
    back = np.ones((len(lengths), e.shape[1]))
    for step in range(len(active) - 1, -1, -1):
        k = active[step]
        at = begin[:k] + step
        b = back[:k]
        scaled = (e[at] * b) @ t.T
        p = forward[at] * b
        forward[at] = p / p.sum(axis=1, keepdims=True)
        back[:k] = scaled / scaled.sum(axis=1, keepdims=True)
    return forward


def spliced(texts: list[list[str]], labels: np.ndarray, chains: int, seed: int) -> tuple[list[list[str]], np.ndarray]:
    """Chains of LENGTH words from segments of random rows, and the language of each word."""
    rng = np.random.default_rng(seed)
    by_label = [np.flatnonzero(labels == k) for k in np.unique(labels)]
    out, gold = [], np.empty((chains, LENGTH), dtype=np.int64)
    for c in range(chains):
        chain: list[str] = []
        while len(chain) < LENGTH:
            rows = by_label[rng.integers(len(by_label))]
            row = rows[rng.integers(len(rows))]
            n = int(rng.integers(*SEGMENT))
            at = int(rng.integers(max(1, len(texts[row]) - n + 1)))
            segment = texts[row][at : at + n][: LENGTH - len(chain)]
            gold[c, len(chain) : len(chain) + len(segment)] = labels[row]
            chain += segment
        out.append(chain)
    return out, gold


def fit(texts: list[str], langs: list[str], seed: int = 13) -> Model | None:
    """The model that maximises the likelihood of the words' languages in spliced chains, by adaptive gradient steps."""
    tokens = [(words(t), g) for t, g in zip(texts, langs, strict=True)]
    tokens = [(w, g) for w, g in tokens if w]
    if not tokens:
        return None
    names = sorted({g for _, g in tokens})
    labels = np.array([names.index(g) for _, g in tokens])
    texts_ = [w for w, _ in tokens]
    size = len(names)
    counts = [Counter(w for row, k in zip(texts_, labels, strict=True) if k == i for w in row) for i in range(size)]
    lexicon = sorted({w for c in counts for w, n in c.items() if n >= LEXICON_COUNT})
    stands = np.zeros((len(lexicon) + 1, size))
    for i, c in enumerate(counts):
        stands[:-1, i] = [c[w] >= LEXICON_COUNT for w in lexicon]
    model = Model(names, np.zeros((SLOTS + 1, size)), lexicon, stands, np.zeros((size, size)), np.zeros((size, size)), np.zeros(size))
    chains, gold = spliced(texts_, labels, CHAINS, seed)
    rates = [np.full(x.shape, 1e-2) for x in (model.weights, model.lexical, model.moves, model.first)]
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(CHAINS), CHAINS // BATCH):
            coded = pa.array([w for i in some for w in chains[i]]).dictionary_encode()
            ids, distinct = coded.indices.to_numpy(), coded.dictionary
            y = gold[some]
            e = model.emissions(distinct)[ids].reshape(len(some), LENGTH, size)
            t = np.exp(model.moves)
            scaled = np.exp(e - e.max(axis=2, keepdims=True))
            forward, back = np.empty_like(e), np.empty_like(e)
            for step in range(LENGTH):
                a = scaled[:, step] * (np.exp(model.first) if step == 0 else forward[:, step - 1] @ t)
                forward[:, step] = a / a.sum(axis=1, keepdims=True)
            back[:, -1] = 1
            for step in range(LENGTH - 2, -1, -1):
                b = (scaled[:, step + 1] * back[:, step + 1]) @ t.T
                back[:, step] = b / b.sum(axis=1, keepdims=True)
            p = forward * back
            p /= p.sum(axis=2, keepdims=True)
            # expected minus seen transitions
            moved = np.zeros((size, size))
            for step in range(LENGTH - 1):
                joint = forward[:, step, :, None] * t * (scaled[:, step + 1] * back[:, step + 1])[:, None]
                moved += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            np.subtract.at(moved, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            p[np.arange(len(some))[:, None], np.arange(LENGTH)[None], y] -= 1
            off = p.reshape(-1, size)
            by_word = np.stack([np.bincount(ids, off[:, k], minlength=len(distinct)) for k in range(size)], axis=1)
            slots, begin = grams(distinct.to_pylist())
            of_word = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, slots.shape[1])))
            hashed = np.zeros_like(model.weights)
            for row in slots:
                for k in range(size):
                    hashed[:, k] += np.bincount(row, by_word[of_word, k], minlength=SLOTS + 1)
            hashed[SLOTS] = 0
            steps = (hashed, model.in_lexicon(distinct).T @ by_word, moved, p[:, 0].sum(axis=0))
            for x, g, r in zip((model.weights, model.lexical, model.moves, model.first), steps, rates, strict=True):
                g = g / len(some) + 1e-6 * x
                r += g * g
                x -= RATE * g / np.sqrt(r)
    model.weights = model.weights.astype(np.float32)
    return model


def label_words(model: Model, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Each word's probabilities of languages, over all texts in turn, and the texts' numbers of words."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    coded = pa.array([w for t in texts for w in t], pa.string()).dictionary_encode()
    if not len(coded):
        return np.zeros((0, len(model.langs))), lengths
    e = model.emissions(coded.dictionary)[coded.indices.to_numpy()]
    some = lengths[lengths > 0]
    return posteriors(e, model.moves, model.first, some), lengths


def predict(model: Model | None, texts: list[list[str]]) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is not None:
        p, lengths = label_words(model, texts)
        rows = np.flatnonzero(lengths)
        if len(rows):
            n = lengths[rows]
            mean = np.add.reduceat(p, np.cumsum(n) - n, axis=0) / n[:, None]
            best = mean.argmax(axis=1)
            for i, k, s in zip(rows.tolist(), best.tolist(), mean.max(axis=1).tolist(), strict=True):
                names[i], scores[i] = model.langs[k], min(s, 1.0)
    return names, scores


def remainder(folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; a null doc_id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def learned(docs: DataFrame, folds: int, held: int, rows: int = SAMPLE_ROWS) -> Model | None:
    """The model fitted on a sample of the labelled training rows, of which each language has its share."""
    training = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(folds) != held))
    counts = {r["lang"]: r["n"] for r in training.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return None
    each = max(1, rows // len(counts))
    share = F.lit(1.0)  # a little more than needed is drawn, then cut
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, (1.2 * each + 50) / n))).otherwise(share)
    draw = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5("text"))
    picked = training.withColumn("draw", draw).where(F.pmod("draw", F.lit(1 << 30)) < share * (1 << 30))
    once = picked.groupBy("lang", "draw").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1 << 30)), "draw")
    sample = once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each).select("draw", "lang", "text").collect()  # SAMPLE_ROWS at most
    sample.sort(key=lambda r: (r["draw"], r["lang"]))
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def identified(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = learned(docs.select("doc_id", "text", "lang"), folds, held)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # slots, lexicon and states: bounded by SLOTS and SAMPLE_ROWS
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            texts: list[list[str]] = []
            held_words = 0
            for text in batch.column("text"):
                texts.append(words(text.as_py()))
                held_words += len(texts[-1])
                if held_words >= BATCH_WORDS:
                    n, s = predict(sent.value, texts)
                    names, scores, texts, held_words = names + n, scores + s, [], 0
            n, s = predict(sent.value, texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names + n, pa.string()), pa.array(scores + s, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (remainder(folds) == held).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
