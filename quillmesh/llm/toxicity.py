"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams (hashed to `BUCKETS` rows), so an
unseen misspelling or compound shares vectors with words seen in training. A window of `WINDOW`
words is the mean of its words and goes through a linear softmax; embeddings and softmax are
trained together by Adam. A document's label is that of its most toxic window: each epoch trains
toxic documents on the window that scores highest so far and clean ones on their highest and on
random windows. The score is the softmax's probability for the highest window, its logit calibrated by a
scale and an offset fitted on the sample (the highest of many windows is higher than one); nothing but words enters it.

Only the fit uses a bounded sample of labelled rows (at most `max_toxic` and `max_clean` documents,
those of the smallest hash of their id; a documented parameter). Scoring covers whole texts of all rows. The model
that is broadcast has a fixed size: a number for each bucket.

Edge cases: null, empty and blank texts have no window and score as a logit of 0 does; repeated rows are scored one by one and count once in the fit; without labelled rows of both
classes, or with empty texts only, every score is the share of toxic ones (0 without any); null labels are not learnt from; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
DIM = 16
WINDOW = 8
GRAMS = (3, 4, 5)
MAX_CACHED = 400_000
STRIP = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def buckets_of(word: str) -> list[int]:
    """The hashed n-grams (of UTF-8 bytes) of a word between its bounds, and the word itself."""
    bare = f"<{word.strip(STRIP)}>".encode("utf-8", "surrogatepass")
    crc, n = zlib.crc32, len(bare)
    return [crc(bare) % BUCKETS] + [crc(bare[i : i + k]) % BUCKETS for k in GRAMS for i in range(n - k + 1)]


class Model:
    """gram: each bucket's part in the logit (embedding times softmax difference); curve: scale and offset of the logit."""

    def __init__(self, gram: np.ndarray, bias: float, curve: np.ndarray) -> None:
        self.gram, self.bias, self.curve = gram, bias, curve
        self.known: dict[str, float] = {}
        self.values: list[float] = gram.tolist()

    def word(self, word: str) -> float:
        values, buckets = self.values, buckets_of(word)
        value = sum([values[b] for b in buckets]) / len(buckets)
        if len(word) <= 64:
            if len(self.known) >= MAX_CACHED:
                self.known.clear()
            self.known[word] = value
        return value

    def peak(self, words: list[str]) -> float:
        if not words:
            return 0.0
        known = self.known.get
        values = np.fromiter((v if (v := known(w)) is not None else self.word(w) for w in words), np.float64, len(words))
        return float(peaks(values)[0].max()) + self.bias

    def score(self, text: str | None) -> float:
        words = words_of(text)
        return curve_value(self.curve, self.peak(words))


def curve_value(curve: np.ndarray, peak: float) -> float:
    z = float(curve @ np.array([peak, 1.0]))
    return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def peaks(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Means over all windows, and their length (that of a shorter text is its own)."""
    size = min(WINDOW, len(values))
    total = np.concatenate([[0.0], np.cumsum(values)])
    return (total[size:] - total[:-size]) / size, size


def fit(texts: list[str], labels: np.ndarray, epochs: int = 14, batch: int = 512, rate: float = 0.01, seed: int = 7, min_steps: int = 250) -> Model:
    """Train on whole texts; labels are 0 or 1. A small sample gets more epochs, for min_steps in all."""
    rng = np.random.default_rng(seed)
    ids: dict[str, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in words_of(t)], np.int64) for t in texts]
    rate_toxic = float(labels.mean()) if len(labels) else 0.0
    if len(set(labels.tolist())) < 2 or not ids:
        level = min(max(rate_toxic, 1e-9), 1 - 1e-9)
        return Model(np.zeros(BUCKETS), 0.0, np.array([0.0, np.log(level / (1 - level))]))
    grams = [np.array(buckets_of(w), np.int64) for w in ids]
    lengths = np.array([len(g) for g in grams])
    flat, starts = np.concatenate(grams), np.concatenate([[0], np.cumsum(lengths)])
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    out[:, 1] = rng.normal(0, 0.1, DIM)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, out, bias)]
    steps = 0
    filled = [i for i, d in enumerate(docs) if len(d)]

    def word_values() -> np.ndarray:
        part = (table @ (out[:, 1] - out[:, 0])).astype(np.float64)
        return np.add.reduceat(part[flat], starts[:-1]) / lengths

    epoch = -1
    while epoch + 1 < epochs or steps < min_steps:
        epoch += 1
        values = word_values()
        windows, wanted = [], []
        for i in filled:
            means, size = peaks(values[docs[i]])
            top = int(means.argmax())
            at = rng.integers(0, len(means), 4) if not epoch else [top] if labels[i] else [top, *rng.integers(0, len(means), 2)]
            windows += [docs[i][a : a + size] for a in at]
            wanted += [int(labels[i])] * len(at)
        order, wanted = rng.permutation(len(windows)), np.array(wanted)
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            size = np.array([len(windows[j]) for j in some])
            words = np.concatenate([windows[j] for j in some])
            per = lengths[words]
            first = np.cumsum(per) - per
            index = flat[np.repeat(starts[words] - first, per) + np.arange(per.sum())]
            row = np.repeat(np.repeat(np.arange(len(some)), size), per)
            weight = (1.0 / (np.repeat(per, per) * np.repeat(np.repeat(size, size), per))).astype(np.float32)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
            hidden = np.add.reduceat(table[index] * weight[:, None], edges)
            logits = hidden @ out + bias
            soft = np.exp(logits - logits.max(1, keepdims=True))
            soft /= soft.sum(1, keepdims=True)
            soft[np.arange(len(some)), wanted[some]] -= 1
            soft /= len(some)
            back = (soft @ out.T)[row] * weight[:, None]
            grad = np.stack([np.bincount(index, back[:, k], BUCKETS) for k in range(DIM)], 1).astype(np.float32)
            steps += 1
            for p, g, (m, v) in zip((table, out, bias), (grad, hidden.T @ soft, soft.sum(0)), state, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    values = word_values()
    offset = float(bias[1] - bias[0])
    top = np.array([peaks(values[d])[0].max() + offset if len(d) else 0.0 for d in docs])
    features = np.stack([top, np.ones(len(docs))], 1)
    curve = np.zeros(2)
    for _ in range(40):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(features @ curve, -30, 30)))
        step = np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + 1e-2 * np.eye(2), features.T @ (p - labels) + 1e-2 * curve)
        curve -= step
        if np.abs(step).max() < 1e-8:
            break
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float64), offset, curve)


def training_rows(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> tuple[list[str], np.ndarray]:
    """The sample: of each class the labelled documents, not held out, with the smallest hash of their id."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic").distinct()
    order = F.xxhash64("doc_id")
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(max_toxic).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(max_clean))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id", "toxic", "text"]).orderBy(order, "doc_id", "toxic", "text").select("text", "toxic").toLocalIterator()
    pairs = [(r["text"] or "", r["toxic"]) for r in rows]
    return [t for t, _ in pairs], np.array([y for _, y in pairs], np.int64)


def toxicity(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_clean: int = 3000, epochs: int = 14) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    model = fit(*training_rows(docs, labels, max_toxic, max_clean), epochs=epochs)
    shared = docs.sparkSession.sparkContext.broadcast((model.gram, model.bias, model.curve))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
