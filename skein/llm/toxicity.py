"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine, over a block-max inverted index.

Terms are whole words and, for longer words, their openings of four and six letters, so that inflected
and compounded forms meet. Every term that two examples of a bounded sample of labelled rows hold enters,
whichever label it goes with. Its weight is its IDF times a power (3/2) of its G statistic's root: how surely it
tells the labels apart, in either direction. Without that factor rare invented words rule the cosines and
neighbours say little about toxicity; the labels thus shape the vectors' metric as well as the votes.

The sample's vectors stand in postings, in blocks of examples; each term keeps its largest weight per block.
Examples that share frequent terms stand in the same blocks. Queries go in batches. A query bounds every block
by those maxima and skips the blocks that cannot reach its k-th best cosine so far: the result is exact. Terms
that many examples of a block hold are a dense matrix there, the others postings.
Votes weigh by cosine; a logistic curve, fitted on a fifth of the sample that the voting index of that step hasn't
seen, turns vote shares into scores.

Defined cases: null and empty texts, and texts with no term of the index, get the share of label 1 among such
examples, or nearly the prior where there are none, and no evidence; equal cosines prefer the smaller doc_id;
repeated rows get equal scores, and an id that repeats among the labelled rows counts once; with no labelled
row every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_sample, by_value, held, slices

WORDS = re.compile(r"[^\W\d_]+")
OPENINGS = (4, 6)
BLOCK = 512
#: Cosines are compared to so many parts of one; examples' numbers take the low bits of a key.
GRAIN, LOW = 10**12, 22
#: Terms that at least one in so many examples of a block holds are dense there.
DENSE = 16


def word_terms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in OPENINGS if len(word) > n)]


def _counted(doc: np.ndarray, item: np.ndarray, times: np.ndarray | None, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (doc, item) pairs as one: docs in order, items in order within, and the sums of ``times`` (or how many)."""
    pairs, which = np.unique(doc * top + item, return_inverse=True)
    return pairs // top, pairs % top, np.bincount(which, times, len(pairs))


class Vocabulary:
    """Numbers of words, and by word the numbers of its terms (-1 beyond the last)."""

    def __init__(self, number):  # noqa: ANN001
        self.number, self.words = number, {}
        self.terms = np.full((1024, len(OPENINGS) + 1), -1, dtype=np.int64)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms of texts: the text, the term, and how often it stands there."""
        words, known = [WORDS.findall(text.lower()) if text else [] for text in texts], self.words
        fresh = list(set().union(*words).difference(known))
        if fresh:
            number, first = self.number, len(known)
            known.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            while len(known) > len(self.terms):
                self.terms = np.concatenate([self.terms, np.full_like(self.terms, -1)])
            for column, n in enumerate((None, *OPENINGS)):  # as word_terms has them
                self.terms[first : len(known), column] = [number(w) for w in fresh] if n is None else [number(w[:n] + "*") if len(w) > n else -1 for w in fresh]
        sizes = np.array([len(own) for own in words], dtype=np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        ids = np.fromiter((known[w] for own in words for w in own), np.int64, sizes.sum())
        doc, ids, times = _counted(doc, ids, None, max(1, len(known)))
        term = self.terms[ids]
        doc, times = np.repeat(doc, term.shape[1]), np.repeat(times, term.shape[1])
        term = term.ravel()
        some = term >= 0
        return _counted(doc[some], term[some], times[some], int(term.max(initial=0)) + 1)


@dataclass
class Index:
    """Examples' unit vectors as postings by block, with block maxima."""

    terms: dict[str, int]
    idf: np.ndarray  # a term's weight at one occurrence
    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray  # by example: its label's share of all labelled rows over its share of the sample
    prior: float
    order: np.ndarray  # by place in the blocks: the example
    rows: np.ndarray  # postings sorted by (block, term, place): the place in its block
    values: np.ndarray  # ... and its weight
    bounds: np.ndarray  # blocks x (terms + 1): where a term's postings of a block begin
    maxima: np.ndarray  # terms x blocks
    place: np.ndarray  # blocks x terms: the term's row of the block's matrix, or -1
    dense: list[np.ndarray]  # by block: weights by term and place
    empty: float = 0.0
    curve: tuple[float, float] = (1.0, 0.0)
    k: int = 25

    def search(self, starts: np.ndarray, terms: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact top k of queries, each with one term at least: per query k keys in rising order, -1 for none.

        ``terms`` and ``q`` hold the queries' terms and weights one after another from ``starts`` on.
        """
        n, size = len(starts), len(self.ids)
        sizes = np.diff(np.append(starts, len(terms)))
        doc = np.repeat(np.arange(n), sizes)
        q = q / np.sqrt(np.add.reduceat(q * q, starts))[doc]
        bound = np.add.reduceat(q[:, None] * self.maxima[terms], starts)
        best = np.full((n, self.k), -1, dtype=np.int64)
        likeliest, blocks = bound.argmax(axis=1), range(bound.shape[1])
        for block, first_turn in [*((b, True) for b in blocks), *((b, False) for b in blocks)]:  # each query's likeliest block first
            open_ = (likeliest == block) == first_turn
            open_ = np.flatnonzero(open_ & (bound[:, block] > 0) & (bound[:, block] >= (best[:, 0] >> LOW) / GRAIN - 1e-9))
            if not len(open_):
                continue
            local = np.full(n, -1)
            local[open_] = np.arange(len(open_))
            asked = np.flatnonzero(local[doc] >= 0)
            term, query, weight = terms[asked], local[doc[asked]], q[asked]
            place = self.place[block, term]
            often, own = place >= 0, np.arange(block * BLOCK, min(size, (block + 1) * BLOCK))
            matrix = np.zeros((len(open_), len(self.dense[block])))
            matrix[query[often], place[often]] = weight[often]
            dots = matrix @ self.dense[block]
            term, query, weight = term[~often], query[~often], weight[~often]
            first = self.bounds[block, term].astype(np.int64)
            count = self.bounds[block, term + 1] - first
            some = count > 0
            first, count, query, weight = first[some], count[some], query[some], weight[some]
            at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())  # the terms' postings in this block
            cell = np.repeat(query * len(own), count) + self.rows[at]
            dots += np.bincount(cell, np.repeat(weight, count) * self.values[at], dots.size).reshape(dots.shape)
            keys = (np.rint(dots * GRAIN).astype(np.int64) << LOW) | ((1 << LOW) - 1 - self.order[own])
            keys[dots <= 0] = -1
            both = np.concatenate([best[open_], keys], axis=1)
            both.partition(both.shape[1] - self.k, axis=1)
            both = both[:, -self.k :]
            both.sort(axis=1)
            best[open_] = both
        return best

    def nearest(self, query: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines, best first, of a query given as weights by term."""
        keys = self.search(np.zeros(1, dtype=np.int64), np.array(list(query), dtype=np.int64), np.array(list(query.values()), dtype=float))[0][::-1]
        keys = keys[keys >= 0]
        return (1 << LOW) - 1 - (keys & (1 << LOW) - 1), (keys >> LOW) / GRAIN

    def shares(self, n: int, doc: np.ndarray, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ``n`` queries (their terms, in order, and how often) the share of label 1 in the votes, NaN without a neighbour; and the keys."""
        share, keys = np.full(n, np.nan), np.full((n, self.k), -1, dtype=np.int64)
        if len(doc):
            some, starts = np.unique(doc, return_index=True)
            keys[some] = found = self.search(starts, terms, (1 + np.log(times)) * self.idf[terms])
            rows = (1 << LOW) - 1 - (found & (1 << LOW) - 1)
            rows[found < 0] = 0
            w = np.where(found >= 0, ((found >> LOW) / GRAIN) ** 4 * self.weights[rows], 0.0)
            share[some] = np.where((found >= 0).any(axis=1), ((w * self.labels[rows]).sum(axis=1) + 0.02 * self.prior) / (w.sum(axis=1) + 0.02), np.nan)
        return share, keys

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return np.where(np.isnan(share), self.empty, 1 / (1 + np.exp(-(a * _logit(share) + b))))

    def query(self, words: Counter) -> dict[int, float]:
        """TF-IDF weights by known term."""
        tf: dict[int, int] = {}
        for word, n in words.items():
            for term in word_terms(word):
                at = self.terms.get(term)
                if at is not None:
                    tf[at] = tf.get(at, 0) + n
        terms = sorted(tf)
        return dict(zip(terms, ((1 + np.log([tf[t] for t in terms])) * self.idf[terms]).tolist(), strict=True)) if tf else {}


def _logit(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def _association(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Signed root of the G statistic of terms that ``a`` of ``n1`` toxic and ``b`` of ``n0`` other examples hold."""
    out = np.zeros(len(a))
    for own, n in ((a, n1), (b, n0)):
        share = (a + b) / (n1 + n0)
        for seen, expected in ((own, share * n), (n - own, (1 - share) * n)):
            out += np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0.0)
    return np.sign(a * n0 - b * n1) * np.sqrt(2 * np.maximum(out, 0.0))


@dataclass
class _Read:
    """Examples as (example, term, count) rows, and how to write a term."""

    row: np.ndarray
    term: np.ndarray
    times: np.ndarray
    names: dict[str, int]

    def of(self, chosen: np.ndarray) -> _Read:
        """The examples of a mask, numbered anew."""
        number = np.cumsum(chosen) - 1
        own = chosen[self.row]
        return _Read(number[self.row[own]], self.term[own], self.times[own], self.names)


def _read(texts: list[str]) -> _Read:
    """Read the sample in steps; then forget the names of terms that stand in one example only."""
    names: dict[str, int] = {}
    vocabulary = Vocabulary(lambda t: names.setdefault(t, len(names)))
    parts = []
    for at in range(0, len(texts), 256):
        doc, term, times = vocabulary.read(texts[at : at + 256])
        parts.append(((doc + at).astype(np.int32), term.astype(np.int32), times.astype(np.int32)))
    row, term, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    shared = np.bincount(term, minlength=len(names)) > 1 if len(texts) > 1 else np.ones(len(names), dtype=bool)
    return _Read(row, term, times, {name: at for name, at in names.items() if shared[at]})


def _index(ids: np.ndarray, labels: np.ndarray, read: _Read, shares: dict[int, float], z: float, most_terms: int | None) -> Index:
    top = int(read.term.max(initial=0)) + 1
    seen = np.stack([np.bincount(read.term[labels[read.row] == y], minlength=top) for y in (0, 1)])
    n = [max(1, int((labels == y).sum())) for y in (0, 1)]
    strength = np.abs(_association(seen[1], seen[0], n[1], n[0]))
    df = seen.sum(axis=0)
    chosen = np.flatnonzero((df > min(1, len(ids) - 1)) & ((strength > z) | (z <= 0)))
    if most_terms is not None:
        chosen = np.sort(chosen[np.argsort(-strength[chosen], kind="stable")[:most_terms]])
    number = np.full(top, -1)
    number[chosen] = np.arange(len(chosen))
    terms = {name: int(number[at]) for name, at in read.names.items() if at < top and number[at] >= 0}
    df = df[chosen]
    idf = (np.log((1 + len(ids)) / (1 + df)) + 1) * (strength[chosen] + 1e-3) ** 1.5
    size, blocks = len(ids), -(-len(ids) // BLOCK)
    own = number[read.term] >= 0
    t, rows, times = number[read.term[own]], read.row[own], read.times[own]
    values = (1 + np.log(times)) * idf[t]
    values /= np.maximum(np.sqrt(np.bincount(rows, values * values, size)), 1e-300)[rows]
    bare = np.bincount(rows, minlength=size) == 0
    order = _blocks(size, t, rows, values, df)
    spot = np.empty(size, dtype=np.int64)
    spot[order] = np.arange(size)
    block, rows = spot[rows] // BLOCK, (spot[rows] % BLOCK).astype(np.int16)
    maxima = np.zeros((len(chosen), blocks))
    np.maximum.at(maxima, (t, block), values)
    place, dense = np.full((blocks, len(chosen)), -1, dtype=np.int32), []
    kept = np.zeros(len(t), dtype=bool)
    for b in range(blocks):
        own, width = np.flatnonzero(block == b), min(BLOCK, size - b * BLOCK)
        often = np.flatnonzero(np.bincount(t[own], minlength=len(chosen)) * DENSE >= width)
        place[b, often] = np.arange(len(often))
        many = place[b, t[own]] >= 0
        dense.append(np.zeros((len(often), width)))
        dense[b][place[b, t[own[many]]], rows[own[many]]] = values[own[many]]
        kept[own[~many]] = True
    t, block, rows, values = t[kept], block[kept], rows[kept], values[kept]
    by_place = np.lexsort((rows, t, block))
    cell, rows, values = (block * len(chosen) + t)[by_place], rows[by_place], values[by_place]
    bounds = np.searchsorted(cell, np.arange(blocks)[:, None] * len(chosen) + np.arange(len(chosen) + 1)[None, :]).astype(np.int32)
    held_by = {y: float((labels == y).mean()) for y in (0, 1)}
    weights = np.array([shares.get(int(y), 0.0) / held_by[int(y)] for y in labels])
    index = Index(terms, idf, ids, labels, weights, shares.get(1, 0.0), order, rows, values, bounds, maxima, place, dense)
    index.empty = float((weights[bare] @ labels[bare] + index.prior * 0.5) / (weights[bare].sum() + 0.5))
    return index


def _blocks(size: int, t: np.ndarray, rows: np.ndarray, values: np.ndarray, df: np.ndarray, most: int = 1024) -> np.ndarray:
    """The examples in an order that puts alike ones together: halved again and again along the leading directions
    of their most frequent terms."""
    if size <= BLOCK:
        return np.arange(size)
    number = np.full(len(df), -1)
    number[np.argsort(-df, kind="stable")[:most]] = np.arange(min(most, len(df)))
    own = number[t] >= 0
    x = np.zeros((size, most), dtype=np.float32)
    x[rows[own], number[t[own]]] = np.sqrt(values[own])
    q = np.random.default_rng(11).standard_normal((most, 6)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    x = x @ q
    out = []

    def halve(own: np.ndarray, depth: int) -> None:
        if len(own) <= BLOCK:
            out.append(np.sort(own))
            return
        own = own[np.argsort(x[own, depth % x.shape[1]], kind="stable")]
        half = max(1, round(len(own) / BLOCK / 2)) * BLOCK
        halve(own[:half], depth + 1)
        halve(own[half:], depth + 1)

    halve(np.arange(size), 0)
    return np.concatenate(out)


def learn(samples: list[tuple[int, str, int]], shares: dict[int, float], z: float = 0.0, most_terms: int | None = None, folds: int = 5) -> Index | None:
    """Fit on (doc_id, text, label); ``shares`` gives each label's share of all labelled rows. One fold fits the curve.

    ``z`` and ``most_terms`` can leave out weak terms; by default none is.
    """
    if not samples:
        return None
    samples = sorted(samples, key=lambda s: s[0])
    ids, labels = np.array([i for i, *_ in samples]), np.array([y for *_, y in samples], dtype=float)
    read, kept_back = _read([text for _, text, _ in samples]), np.arange(len(samples)) % folds == 0
    curve = (1.0, 0.0)
    if len(np.unique(labels[~kept_back])) == 2:
        early = _index(ids[~kept_back], labels[~kept_back], read.of(~kept_back), shares, z, most_terms)
        share, _ = Scorer(early).shares([samples[i][1] for i in np.flatnonzero(kept_back)])
        known, y = ~np.isnan(share), labels[kept_back]
        by_label = np.array([early.weights[early.labels == v][0] for v in (0, 1)])
        curve = _curve(_logit(share[known]), y[known], by_label[y[known].astype(int)])
        del early
    index = _index(ids, labels, read, shares, z, most_terms)
    index.curve = curve
    return index


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """A logistic curve by Newton's method, held near the identity where examples are few."""
    a, b, hold = 1.0, 0.0, 4.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(w * (p - y) * x).sum() + hold * (a - 1), (w * (p - y)).sum() + hold * b])
        v = w * p * (1 - p)
        h = np.array([[(v * x * x).sum() + hold, (v * x).sum()], [(v * x).sum(), v.sum() + hold]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = 3000, max_bytes: int = 1 << 16) -> Index | None:
    """Learn from the texts of ``docs`` with a ``label`` of 0 or 1 in ``labels``: at most ``per_label`` of each, by hash."""
    rows, n = bounded_sample(docs, labels.where(F.col(label).isin(0, 1)), label, per_label, max_bytes, most_bytes=32 << 20)
    return learn(rows, {y: k / sum(n.values()) for y, k in n.items()})


class Scorer:
    """Scores texts in batches; remembers words' known terms."""

    def __init__(self, index: Index, most: int = 200_000):
        self.index, self.most = index, most
        self.vocabulary = self._new()

    def _new(self) -> Vocabulary:
        get = self.index.terms.get
        return Vocabulary(lambda term: get(term, -1))

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.vocabulary.words) > self.most:
            self.vocabulary = self._new()
        parts = [self.index.shares(len(own := texts[at : at + 256]), *self.vocabulary.read(own)) for at in range(0, len(texts), 256)]
        return np.concatenate([share for share, _ in parts]), np.concatenate([keys for _, keys in parts])

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[int]]]:
        """Scores, and the ids of the nearest examples of the label that won."""
        index = self.index
        share, keys = self.shares(texts)
        score, keys = index.calibrated(share), keys[:, ::-1]
        rows = (1 << LOW) - 1 - (keys & (1 << LOW) - 1)
        rows[keys < 0] = 0
        agree = (keys >= 0) & (index.labels[rows] == (score >= 0.5)[:, None])
        return score, [index.ids[own[yes][:3]].tolist() for own, yes in zip(rows, agree, strict=True)]

    def score(self, text: str | None) -> tuple[float, list[int]]:
        score, evidence = self.batch([text])
        return float(score[0]), evidence[0]


def score(docs: DataFrame, index: Index | None) -> DataFrame:
    """Per row of ``docs``: doc_id, score, evidence (ids of the nearest labelled examples that agree)."""
    shared = by_value(docs.sparkSession, index)  # bounded by the sample's size
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared()
        scorer = held("toxicity", key, lambda: Scorer(index)) if index else None
        for big in slices(batches, "text", 1_000_000):
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                found, evidence = scorer.batch(batch.column("text").to_pylist()) if scorer else (np.zeros(batch.num_rows), [[]] * batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double, evidence array<bigint>")
