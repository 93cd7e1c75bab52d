"""Toxicity (operator 3): severity grades by cumulative-link ordinal regression.

P(grade <= k | text) = sigmoid(threshold_k - weights . features), with one vector of
weights for all thresholds, which increase with k. Features of a text are sparse:
the words and word beginnings (of PREFIXES letters) that it has, lower-cased letters
only. Severity is the expectation of the grade, 0 to GRADES - 1.

Fitted on at most SAMPLE labelled documents of each class (a documented bound);
every document is scored whole. Labels that are only 0 or 1 are graded first: a
toxic text's grade is its third, by how many of the features that strongly mark
toxic texts it has. Only distinct texts count, so that copies of one text make no feature.

Defined results: null and empty texts have grade 0 unless most texts are toxic;
texts are read whole; equal texts get equal results; without labels of both kinds
all severities are 0; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import read, split
from .samples import labelled_sample

SAMPLE, GRADES, PREFIXES = 4000, 4, (4, 5, 7)
#: A feature is kept that LEAST_TEXTS sampled texts have and whose log odds lie Z standard errors from 0.
LEAST_TEXTS, Z, STRONG_Z, MAX_FEATURES = 5, 4.0, 5.0, 5000
RIDGE, ROUNDS, RATE = 1e-5, 600, 0.1
_NO_LETTER = re.compile(r"[\W\d_]+")


def features(word: bytes) -> tuple[str, ...]:
    """A word's features: its letters, and their beginnings with a mark."""
    core = _NO_LETTER.sub("", word.decode("utf-8", "replace").lower())
    return (core, *(f"{core[:n]}*" for n in PREFIXES if len(core) >= n)) if core else ()


@dataclass
class Model:
    """weights by feature; thresholds in increasing order, one fewer than grades."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (20.0, 30.0, 40.0)

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and k."""
        return 1 / (1 + np.exp(np.clip(np.asarray(self.thresholds)[None, :] - score[:, None], -500, 500)))


def _coded(texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
    """The distinct features of each text as numbers, and the features by number."""
    numbers: dict[str, int] = {}
    known: dict[bytes, tuple[int, ...]] = {}
    rows = []
    for text in texts:
        found: set[int] = set()
        for word in set(split(text)):
            if (of := known.get(word)) is None:
                of = known[word] = tuple(numbers.setdefault(f, len(numbers)) for f in features(word))
            found.update(of)
        rows.append(np.array(sorted(found), np.int32))
    return rows, list(numbers)


def _graded(rows: list[np.ndarray], labels: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """Labels as grades; two-valued ones by thirds of the number of strong features."""
    if labels.max(initial=0) > 1:
        return np.minimum(labels, GRADES - 1)
    marks = np.array([int(strong[found].sum()) for found in rows])
    cuts = np.quantile(marks[labels == 1], [i / (GRADES - 1) for i in range(1, GRADES - 1)])
    return np.where(labels == 1, 1 + np.searchsorted(cuts, marks, side="right"), 0)


def fit(texts: list[tuple[str, int]], class_weight: dict[int, float]) -> Model:
    """texts: (text, label). Adam on the ordinal likelihood with a ridge; no randomness."""
    texts = list(dict(texts).items())
    labels = np.array([label for _, label in texts], np.int64)
    toxic, clean = int((labels > 0).sum()), int((labels == 0).sum())
    if not toxic or not clean:
        return Model()
    rows, every = _coded([text for text, _ in texts])
    a, b = (np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if (y > 0) == kind]), minlength=len(every)) for kind in (True, False))
    p, q = (a + 0.5) / (toxic + 1), (b + 0.5) / (clean + 1)
    odds = np.log(p / (1 - p) * (1 - q) / q) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (toxic - a + 0.5) + 1 / (clean - b + 0.5))
    chosen = sorted(np.flatnonzero((a > 0) & (a + b >= LEAST_TEXTS) & (np.abs(odds) >= Z)).tolist(), key=lambda i: (-abs(odds[i]), every[i]))[:MAX_FEATURES]
    names = [every[i] for i in chosen]
    place, strong = np.full(len(every), -1, np.int64), np.zeros(len(every), bool)
    place[chosen] = np.arange(len(chosen))
    strong[chosen] = odds[chosen] >= STRONG_Z
    if not strong.any():
        strong[chosen] = True
    grades = _graded(rows, labels, strong)
    held = [place[r][place[r] >= 0] for r in rows]
    row, col = np.repeat(np.arange(len(rows)), [len(h) for h in held]), np.concatenate(held)
    weight = np.array([class_weight.get(int(y > 0), 1.0) for y in labels])
    weight /= weight.sum()
    n_cuts = GRADES - 1
    # Thresholds as a first one and the logarithms of the gaps.
    parameters = np.concatenate([np.zeros(len(names)), [2.0], np.zeros(n_cuts - 1)])
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, ROUNDS + 1):
        w, gaps = parameters[: len(names)], np.exp(parameters[len(names) + 1 :])
        cuts = parameters[len(names)] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row, w[col], len(rows))
        upto = np.column_stack([np.zeros(len(rows)), 1 / (1 + np.exp(np.clip(score[:, None] - cuts[None, :], -500, 500))), np.ones(len(rows))])
        slope = upto * (1 - upto)
        i = np.arange(len(rows))
        p = np.maximum(upto[i, grades + 1] - upto[i, grades], 1e-12)
        high, low = weight * slope[i, grades + 1] / p, weight * slope[i, grades] / p
        by_score = high - low  # of the negative log likelihood
        by_cut = np.zeros(n_cuts + 2)
        np.add.at(by_cut, grades + 1, -high)
        np.add.at(by_cut, grades, low)
        by_cut = by_cut[1:-1]
        gradient = np.concatenate([np.bincount(col, by_score[row], len(names)) + RIDGE * w, [by_cut.sum()], [by_cut[k + 1 :].sum() * gaps[k] for k in range(n_cuts - 1)]])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        parameters -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    w = parameters[: len(names)]
    cuts = parameters[len(names)] + np.concatenate([[0.0], np.cumsum(np.exp(parameters[len(names) + 1 :]))])
    return Model({f: float(w[k]) for k, f in enumerate(names)}, tuple(cuts.tolist()))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    rows, counts = labelled_sample(docs, labels, label, sample)
    texts = sorted({(r["text"], r["label"]) for r in rows.select("text", "label").collect()})
    sampled = Counter(int(y > 0) for _, y in texts)
    labelled = Counter()
    for y, n in counts.items():
        labelled[int(y > 0)] += n
    return fit(texts, {y: labelled[y] / sampled[y] for y in sampled})


def graded(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: toxic, the likeliest grade, p_toxic and the expected severity."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("toxic", T.BooleanType()), T.StructField("grade", T.IntegerType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("expected_severity", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known: dict[bytes, tuple[str, ...]] = {}
        for batch in batches:
            scores = []
            for value in batch.column(1):
                found: set[str] = set()
                for word in set(split(value.as_py() or "")):
                    has = known.get(word)
                    if has is None:
                        if len(known) >= 200_000:
                            known.clear()
                        has = known[word] = tuple(f for f in features(word) if f in m.weights)
                    found.update(has)
                scores.append(sum(m.weights[f] for f in sorted(found)))
            above = m.above(np.array(scores))
            p = -np.diff(np.column_stack([np.ones(len(scores)), above, np.zeros(len(scores))]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above[:, 0] >= 0.5), pa.array(p.argmax(axis=1).astype("int32")), pa.array(above[:, 0]), pa.array(above.sum(axis=1))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return graded(docs, fitted(docs, read(spark, sf_dir, "labels")))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
