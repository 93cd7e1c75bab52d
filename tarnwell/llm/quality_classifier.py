"""Quality classifier (operator 4): random indexing, pooling, a small network.

Words. Each word gives two units: its lower-cased letters, and its shape (letters,
digits and other characters as runs of a, A, 0 and themselves). Every unit has a
sparse random index vector, drawn from a hash of its name. A unit's context vector
is the sum of the index vectors of the units beside it in the sample, scaled to
length 1; its word vector is the sum of index and context vector. Letters that the
sample lacks share OTHERS index vectors by hash.

Documents are the means of their words' vectors, with the shares of words that
repeat the word before and of distinct words. A network of two layers in numpy gives
a logit, and the probability is sigmoid(logit / temperature), the temperature chosen
for the likelihood of a part of the sample that the network is not fitted on.

Fitted on at most SAMPLE labelled documents of each class (a documented bound), and
only on rows with crc32(doc_id as text) mod 3 other than 1. Only texts are inputs.

Defined results: null and empty texts get the score of a document without words;
texts are read whole; equal texts get equal scores; without labels of both kinds the
score is the share of label 1, or 0.5 without any; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import own, read, split
from .samples import labelled_sample

SAMPLE, DIMENSIONS, NONZERO, OTHERS, MAX_UNITS, LEAST_COUNT, REACH = 4000, 96, 4, 1024, 20_000, 3, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 60, 128, 3e-3, 1e-4, 7
DENSE = 2
_LETTERS = re.compile(r"[\W\d_]+")
_SHAPE = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a"), (re.compile(r"\d+"), lambda m: "0"))


def core(word: str) -> str:
    return "c:" + _LETTERS.sub("", word.lower())


def shape(word: str) -> str:
    for pattern, short in _SHAPE:
        word = pattern.sub(short, word)
    return "s:" + re.sub(r"(.)\1+", r"\1\1", word)[:12]


def units_of(word: bytes) -> tuple[str, str]:
    text = word.decode("utf-8", "replace")
    return core(text), shape(text)


def index_vector(unit: str) -> np.ndarray:
    """NONZERO entries of +-1 at places drawn from the name's hash."""
    draw = np.random.default_rng(zlib.crc32(unit.encode("utf-8", "replace")))
    vector = np.zeros(DIMENSIONS, np.float32)
    vector[draw.choice(DIMENSIONS, NONZERO, replace=False)] = draw.choice([-1.0, 1.0], NONZERO)
    return vector


class Vectors:
    """Word vectors: rows of a table; unit names that have a row, and OTHERS rows after them."""

    def __init__(self, names: list[str], table: np.ndarray):
        self.rows, self.table, self.cache = {n: i for i, n in enumerate(names)}, table, {}

    def of_word(self, word: bytes) -> tuple[int, int]:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) >= 300_000:
                self.cache.clear()
            got = self.cache[word] = tuple(self.rows.get(u, len(self.rows) + zlib.crc32(u.encode()) % OTHERS) for u in units_of(word))
        return got

    def pooled(self, text: str) -> np.ndarray:
        words = split(text)
        if not words:
            return np.zeros(DIMENSIONS + DENSE, np.float32)
        ids = np.array([self.of_word(w) for w in words])
        counts = np.bincount(ids.ravel())
        used = counts.nonzero()[0]
        mean = counts[used].astype(np.float32) @ self.table[used] / len(words)
        again = float((ids[1:, 0] == ids[:-1, 0]).sum()) / len(words)
        return np.concatenate([mean, [again, len(np.unique(ids[:, 0])) / len(words)]]).astype(np.float32)


def learn_vectors(texts: list[str]) -> Vectors:
    counts: Counter[str] = Counter()
    sequences = []
    memo: dict[bytes, tuple[str, str]] = {}
    for text in texts:
        units = []
        for word in split(text):
            got = memo.get(word) or memo.setdefault(word, units_of(word))
            units.append(got)
            counts.update(got)
        sequences.append(units)
    names = sorted((u for u, n in counts.items() if n >= LEAST_COUNT), key=lambda u: (-counts[u], u))[:MAX_UNITS]
    at = {u: i for i, u in enumerate(names)}
    index = np.array([index_vector(u) for u in names + [f"other {i}" for i in range(OTHERS)]], np.float32).reshape(-1, DIMENSIONS)
    slots = np.array([np.flatnonzero(v)[:NONZERO] for v in index[: len(names)]], np.int64).reshape(-1, NONZERO)
    signs = np.take_along_axis(index[: len(names)], slots, 1) if names else np.zeros((0, NONZERO), np.float32)
    context = np.zeros(len(names) * DIMENSIONS)
    for units in sequences:
        for kind in (0, 1):
            ids = np.array([at.get(u[kind], -1) for u in units], np.int64)
            for step in range(1, REACH + 1):
                for here, there in ((ids[:-step], ids[step:]), (ids[step:], ids[:-step])):
                    ok = (here >= 0) & (there >= 0)
                    here, there = here[ok], there[ok]
                    np.add.at(context, (here[:, None] * DIMENSIONS + slots[there]).ravel(), signs[there].ravel())
    context = context.reshape(-1, DIMENSIONS)
    index[: len(names)] += (context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    return Vectors(names, index)


@dataclass
class Model:
    vectors: Vectors | None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0
    share: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.layers:
            return np.full(len(texts), self.share)
        # Row by row: the score of a text does not depend on the batch it comes in.
        logits = np.array([self.logits(self.vectors.pooled(t)[None, :])[0] for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(logits / self.temperature, -500, 500)))


def fit(rows: list[tuple[str, int, int]], class_weight: dict[int, float]) -> Model:
    """rows: (text, label 0 or 1, key); a fifth by key calibrates."""
    labels = {y for _, y, _ in rows}
    if len(labels) < 2:
        return Model(None, share=float(next(iter(labels), 0.5)))
    vectors = learn_vectors([t for t, _, _ in rows])
    x = np.array([vectors.pooled(t) for t, _, _ in rows], np.float64)
    y = np.array([v for _, v, _ in rows], float)
    weight = np.array([class_weight.get(v, 1.0) for _, v, _ in rows])
    held = np.array([k % 5 == 0 for _, _, k in rows]) if len(rows) >= 50 else np.zeros(len(rows), bool)
    mean, scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-3
    draw = np.random.default_rng(SEED)
    d = x.shape[1]
    layers = [draw.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(())]
    model = Model(vectors, mean, scale, tuple(layers))
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    train = np.flatnonzero(~held)
    z = (x - mean) / scale
    for _ in range(EPOCHS):
        for at in np.array_split(draw.permutation(train), max(1, len(train) // BATCH)):
            step += 1
            before = z[at] @ layers[0] + layers[1]
            hidden = np.maximum(before, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -500, 500)))
            error = weight[at] * (p - y[at]) / weight[at].sum()
            back = np.outer(error, layers[2]) * (before > 0)
            for i, g in enumerate((z[at].T @ back + DECAY * layers[0], back.sum(axis=0), hidden.T @ error + DECAY * layers[2], error.sum())):
                first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g**2
                layers[i] = layers[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model.layers = tuple(layers)
    model.share = float((weight * y).sum() / weight.sum())
    if held.sum() >= 10:
        logits, truth, w = model.logits(x[held]), y[held], weight[held]
        grid = np.exp(np.linspace(np.log(0.5), np.log(10), 60))
        model.temperature = float(grid[np.argmin([(w * np.logaddexp(0, np.where(truth == 1, -logits, logits) / t)).sum() for t in grid])])
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id") -> Model:
    rows, counts = labelled_sample(docs, labels, label, sample, allowed=~held_out(id_col), id_col=id_col)
    texts = sorted({(r["text"], r["label"], r["key"]) for r in rows.collect()}, key=lambda r: (r[2], r[1], r[0]))
    sampled = Counter(y for _, y, _ in texts)
    return fit(texts, {y: counts[y] / n for y, n in sampled.items()})


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: held_out, score and predicted."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.scores([v.as_py() or "" for v in batch.column(2)]), pa.float64())], names=schema.names)

    rows = docs.select(id_col, held_out(id_col).alias(own("held")), text_col).mapInArrow(run, schema)
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, read(spark, sf_dir, "labels")))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLES: dict[str, str] = {}
