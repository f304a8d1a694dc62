"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of `WORDS` words, all of them. A passage is described by its make-up (shares of kinds of
characters and of pairs of kinds, repetition, word lengths) and encoded by a dense layer. Gated
attention, tanh(V h) * sigmoid(U h) projected to a number, softmax over the document's passages, weighs the
encodings; a logistic unit scores the weighted mean. Only documents are labelled: encoder, attention and scorer learn
jointly, by Adam in numpy, which passages tell.

Only the fit uses a bounded sample: of the labelled documents those `max_docs` with the smallest hash of their id, and of each
at most `max_passages` passages, evenly spread (documented parameters; the driver takes their descriptions, never texts). Scoring covers
all passages of all texts. The model that is broadcast has a fixed size.

Edge cases: null, empty and blank texts have one passage without words, which is described by zeros and scored like any other; repeated
rows are scored one by one and count once in the fit; null labels and labels other than 0 and 1 are not learnt from; without labelled rows of both
classes every score is the share of label 1 (0.5 without any); an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 48
#: Passages described at once.
GROUP = 2048
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LOWER, UPPER, DIGIT, SPACE, HIGH = range(5)
KINDS, COARSE = 5 + len(PUNCTUATION), 6
N_FEATURES = KINDS + COARSE * COARSE + 5


def _kinds() -> np.ndarray:
    """The kind of each byte: lower, upper, digit, space, part of a longer character, or a punctuation mark of its own."""
    out = np.full(256, SPACE, np.int64)
    out[0x80:] = HIGH
    for first, last, kind in (("a", "z", LOWER), ("A", "Z", UPPER), ("0", "9", DIGIT)):
        out[ord(first) : ord(last) + 1] = kind
    for i, c in enumerate(PUNCTUATION):
        out[ord(c)] = 5 + i
    return out


KIND = _kinds()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def passages_of(text: str | None) -> list[list[str]]:
    """All words in passages, the last one shorter; a text without words has one empty passage."""
    words = (text or "").split()
    return [words[i : i + WORDS] for i in range(0, len(words), WORDS)] or [[]]


def describe(passages: list[list[str]]) -> np.ndarray:
    """A row of N_FEATURES for each passage."""
    n = len(passages)
    raw = [" ".join(p).encode("utf-8", "surrogatepass") for p in passages]
    sizes = np.array([len(r) for r in raw])
    kind = KIND[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(n), sizes)
    single = np.bincount(owner * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS)
    coarse = np.minimum(kind, 5)
    inside = owner[1:] == owner[:-1]
    pair = (owner[1:] * COARSE * COARSE + coarse[:-1] * COARSE + coarse[1:])[inside]
    double = np.bincount(pair, minlength=n * COARSE * COARSE).reshape(n, COARSE * COARSE)
    share = np.sqrt(np.hstack([single, double]) / np.maximum(sizes, 1)[:, None])
    words = np.array([[len(p), len(set(p)), sum(map(eq, p, p[1:])), max(map(len, p), default=0)] for p in passages], np.float64)
    count = np.maximum(words[:, 0], 1)
    rest = np.stack([words[:, 1] / count, words[:, 2] / count, np.log1p(words[:, 3]), sizes / count / 10, np.log1p(words[:, 0]) / 4], 1)
    rest[words[:, 0] == 0] = 0
    return np.hstack([share, rest]).astype(np.float32)


class Model:
    """center, scale of the descriptions; encoder (w, b); gate (v, u, a); scorer (c, d)."""

    SHAPES = {"w": (N_FEATURES, 24), "b": (24,), "v": (24, 16), "u": (24, 16), "a": (16,), "c": (24,), "d": ()}

    def __init__(self, center: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray]) -> None:
        self.center, self.scale, self.weights = center, scale, weights

    def forward(self, rows: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """rows: the passages of some documents, whose first rows are starts."""
        k = self.weights
        sizes = np.diff(np.append(starts, len(rows)))
        x = (rows - self.center) * self.scale
        h = np.tanh(x @ k["w"] + k["b"])
        t, s = np.tanh(h @ k["v"]), 1 / (1 + np.exp(-(h @ k["u"])))
        e = (t * s) @ k["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        e /= np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(e[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(z @ k["c"] + k["d"], -30, 30)))
        return {"sizes": sizes, "x": x, "h": h, "t": t, "s": s, "e": e, "z": z, "p": p}

    def backward(self, f: dict[str, np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy."""
        k = self.weights
        g = (f["p"] - labels) / len(labels)
        dz = np.repeat(g[:, None] * k["c"], f["sizes"], axis=0)
        along = (dz * f["h"]).sum(1)
        mean = np.repeat((np.add.reduceat(f["e"] * along, np.cumsum(f["sizes"]) - f["sizes"])), f["sizes"])
        de = f["e"] * (along - mean)
        dts = de[:, None] * k["a"]
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        dh = dz * f["e"][:, None] + dt @ k["v"].T + ds @ k["u"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"w": f["x"].T @ dx, "b": dx.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ ds, "a": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ g, "d": g.sum()}

    def scores(self, docs: list[list[list[str]]]) -> list[float]:
        """The scores of documents, given as lists of passages. Passages are described in groups, so a long document takes no more memory than its words."""
        sizes = [len(d) for d in docs]
        starts = np.cumsum([0, *sizes[:-1]])
        flat = [p for d in docs for p in d]
        rows = np.concatenate([describe(flat[i : i + GROUP]) for i in range(0, len(flat), GROUP)])
        return self.forward(rows, starts)["p"].tolist()


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.005, decay: float = 1e-4, seed: int = 11) -> Model:
    """bags: descriptions of the passages of each document; labels: 0 or 1."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    weights = {n: rng.normal(0, 1 / np.sqrt(s[0]) if s else 0, s) for n, s in Model.SHAPES.items()}
    weights["b"], weights["d"] = np.zeros(24), np.float64(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    if len(set(labels.tolist())) < 2:
        weights["c"] = np.zeros(24)
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), weights)
    every = np.concatenate(bags).astype(np.float64)
    deviation = every.std(0)
    model = Model(every.mean(0), np.where(deviation > 1e-6, 1 / np.maximum(deviation, 1e-6), 0.0), weights)
    state = {n: [np.zeros(s), np.zeros(s)] for n, s in Model.SHAPES.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        pace = rate * (1 - epoch / epochs)
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            starts = np.cumsum([0, *[len(bags[i]) for i in some[:-1]]])
            grads = model.backward(model.forward(np.concatenate([bags[i] for i in some]), starts), labels[some])
            step += 1
            for n, g in grads.items():
                g = g + decay * weights[n] if n != "d" else g
                m, v = state[n]
                state[n] = [0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g]
                weights[n] = weights[n] - pace * (state[n][0] / (1 - 0.9**step)) / (np.sqrt(state[n][1] / (1 - 0.999**step)) + 1e-8)
    return model


def training_bags(docs: DataFrame, labels: DataFrame, max_docs: int, max_passages: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sample's descriptions, made where the texts are."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id", "quality", "text"]).select("doc_id", "quality", F.xxhash64("text").alias("h"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int64()), ("h", pa.int64()), ("bag", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = []
            for text in batch.column(3):
                passages = passages_of(text.as_py())
                if len(passages) > max_passages:
                    passages = [passages[i] for i in np.linspace(0, len(passages) - 1, max_passages).astype(int)]
                bags.append(describe(passages).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), batch.column(2), pa.array(bags, pa.binary())], schema=schema)

    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("quality"), "h", "text")
    found = rows.mapInArrow(run, "doc_id bigint, quality bigint, h bigint, bag binary").orderBy("doc_id", "quality", "h").toLocalIterator()
    pairs = [(np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES), r["quality"]) for r in found]
    return [b for b, _ in pairs], np.array([y for _, y in pairs], np.float64)


def passage_quality(docs: DataFrame, labels: DataFrame, max_docs: int = 6000, max_passages: int = 48, epochs: int = 30) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 from 0.3 on), n_passages."""
    model = fit(*training_bags(docs, labels, max_docs, max_passages), epochs=epochs)
    shared = docs.sparkSession.sparkContext.broadcast((model.center, model.scale, model.weights))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("n_passages", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            scores, sizes, held = [], [], []
            for text in batch.column(2):
                held.append(passages_of(text.as_py()))
                if sum(map(len, held[-64:])) > GROUP or len(held) >= 256:
                    scores += own.scores(held)
                    sizes += map(len, held)
                    held = []
            if held:
                scores += own.scores(held)
                sizes += map(len, held)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    out = rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, n_passages bigint")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_passages")
