"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent space.

A text's features are hashed trigrams, damped, weighted by inverse document frequency and normalised: trigrams
of its characters (letter case aside), which say what it is about, and trigrams of character classes (letters,
capitals, digits, each mark by itself), which say how it is written. A truncated SVD of a bounded
sample of labelled rows gives the latent axes; the sample's vectors are broadcast. Every text's cosines
with all of them are computed exactly, in blocks, and the nearest vote with their labels.

Defined cases: null and empty text have no features and get the prior share of label 1; repeated rows get
equal scores, and an id that repeats among the labelled rows counts once; with no labelled row every score
is 0.5; equal cosines vote for all in sample order; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import bounded_sample, by_value, slices

#: Features of each sort, and the weight of characters beside classes: chosen on held-out rows of sf0.01 and sf0.1.
EACH, CONTENT = 4096, 0.25
WIDTH = 2 * EACH


def _classes() -> np.ndarray:
    """By byte: 1 lower case and other scripts, 2 capitals, 3 digits, 4 line end, 5 space, then each mark."""
    table = np.ones(256, dtype=np.int64)
    marks = 6
    for b in range(128):
        c = chr(b)
        if c.islower():
            table[b] = 1
        elif c.isupper():
            table[b] = 2
        elif c.isdigit():
            table[b] = 3
        elif c in "\n\r":
            table[b] = 4
        elif c.isspace() or b < 32:
            table[b] = 5
        else:
            table[b] = marks
            marks += 1
    return table


CLASSES = _classes()


LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.int64)


def _trigrams(x: np.ndarray, kinds: int) -> np.ndarray:
    code = (x[:-2] * kinds + x[1:-1]) * kinds + x[2:]
    return np.bincount((code * 2654435761 >> 11) % EACH, minlength=EACH)


def features(texts: list[str | None]) -> np.ndarray:
    """Damped counts of hashed trigrams, a row per text: of classes, then of characters."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    for i, text in enumerate(texts):
        x = np.frombuffer((text or "").encode(), dtype=np.uint8)
        if len(x) > 2:
            out[i, :EACH] = _trigrams(CLASSES[x], 40)
            out[i, EACH:] = _trigrams(LOWER[x], 256)
    np.log1p(out, out=out)
    out[:, EACH:] *= CONTENT
    return out


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # WIDTH x dimensions
    vectors: np.ndarray  # sample x dimensions, of length 1
    labels: np.ndarray
    prior: float
    weights: np.ndarray  # by sample row: its label's share of all labelled rows over its share of the sample
    neighbours: int

    def embed(self, texts: list[str | None]) -> np.ndarray:
        x = features(texts) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        v = x @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str | None], sharp: float = 8.0) -> np.ndarray:
        v = self.embed(texts)
        cosines = v @ self.vectors.T
        k = min(self.neighbours, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cosines, near, axis=1), 0) ** sharp * self.weights[near]
        share = ((w * self.labels[near]).sum(axis=1) + 0.05 * self.prior) / (w.sum(axis=1) + 0.05)
        return np.where(np.abs(v).sum(axis=1) > 0, share, self.prior).astype(float)


def learn(samples: list[tuple[str, int]], shares: dict[int, float], dimensions: int = 48, neighbours: int = 15) -> Model | None:
    """Fit on (text, label) pairs; ``shares`` gives each label's share of all labelled rows."""
    if not samples:
        return None
    texts, labels = [t for t, _ in samples], np.array([y for _, y in samples], dtype=float)
    x = features(texts)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    dimensions = min(dimensions, len(x))
    q = np.random.default_rng(7).standard_normal((WIDTH, dimensions + 16)).astype(np.float32)
    for _ in range(4):  # subspace iteration towards the leading right singular vectors
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    axes = np.ascontiguousarray((q @ vt.T)[:, :dimensions])
    v = x @ axes
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    own = {y: float((labels == y).mean()) for y in (0, 1)}
    weights = np.array([shares.get(int(y), 0.0) / own[int(y)] for y in labels])
    return Model(idf, axes, v.astype(np.float32), labels, shares.get(1, 0.5), weights, neighbours)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = 2000, max_bytes: int = 1 << 17) -> Model | None:
    """Learn from the texts of ``docs`` with a ``label`` of 0 or 1 in ``labels``: at most ``per_label`` of each, by hash."""
    rows, n = bounded_sample(docs, labels.where(F.col(label).isin(0, 1)), label, per_label, max_bytes, most_bytes=64 << 20)
    return learn([(text, y) for _, text, y in rows], {y: k / sum(n.values()) for y, k in n.items()})


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of ``docs``: doc_id and score (0 to 1, higher: label 1 likelier)."""
    shared = by_value(docs.sparkSession, model)  # bounded: the axes and at most 2 x per_label vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for big in slices(batches, "text", 2_000_000):
            for at in range(0, big.num_rows, 256):  # a block of cosines is 256 x the sample
                batch = big.slice(at, 256)
                values = model.score(batch.column("text").to_pylist()) if model else np.full(batch.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def scorer(spark: SparkSession, model: Model | None):  # noqa: ANN201
    """``score`` as a function of a text column."""
    shared = by_value(spark, model)

    @F.pandas_udf("double")
    def of(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        model, values = shared(), texts.tolist()
        found = [model.score(values[at : at + 256]) if model else np.full(len(values[at : at + 256]), 0.5) for at in range(0, len(values), 256)]
        return pd.Series(np.concatenate(found) if found else np.zeros(0))

    return of
