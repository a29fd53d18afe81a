"""Language identification: interpolated Kneser-Ney character models, one per language.

A model is learned from a bounded sample of labelled rows (``per_language`` texts of at most
``max_bytes`` each). Texts are lower-cased and read as runs of letters, each between word marks; a run's
log-probability depends on the run alone, so scoring caches runs. All languages' models share one sorted
array of n-gram hashes for each order, with a column of probabilities and back-off weights per language.

Defined cases: null text or text without a letter (Unicode category L) gives ``und`` with score 0; equal entropies go to the
first language by name; repeated rows get equal answers; with no labelled row every text is ``und``;
extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_sample, by_value, held, slices

LETTERS = re.compile(r"[^\W\d_]+")
ORDER = 5
DISCOUNT = 0.75
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _runs(text: str | None) -> list[str]:
    runs = LETTERS.findall(text.lower()) if text else []
    if runs and not "".join(runs).isalpha():  # Python's class takes numbers that aren't digits for letters
        runs = "".join(c if c.isalpha() else " " for c in " ".join(runs)).split()
    return runs


def _grams(runs: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes by order of the n-grams that end at each predicted character; the run of each; valid orders.

    A run is padded as ``<run>`` and all but the opening mark are predicted. An n-gram never reaches
    before its run's opening mark: ``reach`` is the longest order at a position.
    """
    hashes, sizes = _all_positions(runs)
    at = np.arange(len(hashes[0])) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    predicted = at > 0
    owner = np.repeat(np.arange(len(runs)), sizes)[predicted]
    return [x[predicted] for x in hashes], owner, np.minimum(at[predicted] + 1, ORDER)


@dataclass
class Model:
    """``keys[n]``: sorted hashes of the (n+1)-grams; ``gain[n]`` and, for contexts, ``weight[n]`` by language."""

    languages: list[str]
    keys: list[np.ndarray]
    gain: list[np.ndarray]
    context_keys: list[np.ndarray]
    weight: list[np.ndarray]
    base: float
    sharpness: float
    reject_above: float

    def entropies(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per run the summed negative log-probability by language, and the count of predicted characters."""
        hashes, owner, reach = _grams(runs)
        contexts = _contexts(runs)
        p = np.full((len(owner), len(self.languages)), self.base)
        for n in range(ORDER):
            usable = reach > n
            gain = _lookup(self.keys[n], self.gain[n], hashes[n], 0.0)
            weight = _lookup(self.context_keys[n], self.weight[n], contexts[n], 1.0)
            p = np.where(usable[:, None], gain + weight * p, p)
        cost = -np.log(p)
        out = np.stack([np.bincount(owner, weights=cost[:, j], minlength=len(runs)) for j in range(cost.shape[1])], axis=1)
        return out, np.bincount(owner, minlength=len(runs))


def _contexts(runs: list[str]) -> list[np.ndarray]:
    """Hashes by order of the context before each predicted character (order 1: the empty context)."""
    hashes_all, sizes = _all_positions(runs)
    n = len(hashes_all[0])
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = np.flatnonzero(np.arange(n) > starts) - 1
    return [np.zeros(len(before), dtype=np.uint64), *[h[before] for h in hashes_all[:-1]]]


def _all_positions(runs: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    joined = "".join(f"\x02{run}\x03" for run in runs)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    hashes, h = [], np.zeros(len(points), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(ORDER):
            older = np.zeros_like(points)
            older[n:] = points[: max(0, len(points) - n)]
            h = (h ^ (older + np.uint64(n + 1))) * _PRIME
            h = h ^ (h >> np.uint64(29))
            hashes.append(h)
    return hashes, np.array([len(run) + 2 for run in runs], dtype=np.int64)


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    """Rows of ``values`` at the sorted ``keys``; ``missing`` where a hash isn't there."""
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], missing)


def learn(samples: list[tuple[str, str]], folds: int = 5) -> Model | None:
    """Fit on (text, language) pairs; one fold is kept for the calibration of sharpness and rejection."""
    runs_of = [(_runs(text), lang) for text, lang in samples]
    runs_of = [(runs, lang) for runs, lang in runs_of if runs]
    if not runs_of:
        return None
    fitted = _fit([x for i, x in enumerate(runs_of) if i % folds or len(runs_of) < 2 * folds])
    checked = [x for i, x in enumerate(runs_of) if not i % folds and x[1] in fitted.languages]
    rows, best, right = [], [], []
    for runs, lang in checked:
        cost, n = fitted.entropies(runs)
        h = cost.sum(axis=0) / n.sum()
        rows.append(h)
        best.append(h.min())
        right.append(fitted.languages.index(lang))
    h = np.array(rows) - np.array(best)[:, None]
    loss = {t: -np.mean(np.log(np.maximum(_posterior(h, t)[np.arange(len(right)), right], 1e-9))) for t in (1, 2, 4, 8, 16, 32)}
    final = _fit(runs_of)
    final.sharpness = float(min(loss, key=loss.get))
    final.reject_above = float(np.quantile(best, 0.995) * 1.25)
    return final


def _posterior(h: np.ndarray, sharpness: float) -> np.ndarray:
    z = np.exp(-sharpness * (h - h.min(axis=1, keepdims=True)))
    return z / z.sum(axis=1, keepdims=True)


def _fit(runs_of: list[tuple[list[str], str]]) -> Model:
    languages = sorted({lang for _, lang in runs_of})
    alphabet = {c for runs, _ in runs_of for run in runs for c in run}
    grams: list[list[tuple[np.ndarray, ...]]] = []  # by language, by order: gram hash, its context's hash, shorter gram's hash, count
    for lang in languages:
        runs = [run for own, other in runs_of if other == lang for run in own]
        hashes, _, reach = _grams(runs)
        contexts = _contexts(runs)
        rows = []
        for n in range(ORDER):
            keep = reach > n
            key, first, count = np.unique(hashes[n][keep], return_index=True, return_counts=True)
            rows.append((key, contexts[n][keep][first], hashes[n - 1][keep][first] if n else key, count))
        grams.append(rows)
    keys, gain, context_keys, weight = [], [], [], []
    for n in range(ORDER):
        tables = []
        for rows in grams:
            key, context, _, count = rows[n]
            count = count.astype(float)
            if n < ORDER - 1:  # lower orders count the contexts that a gram continues
                longer = rows[n + 1]
                shorter, kinds = np.unique(longer[2], return_counts=True)
                at = np.minimum(np.searchsorted(shorter, key), max(len(shorter) - 1, 0))
                known = (shorter[at] == key) if len(shorter) else np.zeros(len(key), dtype=bool)
                count = np.where(known, kinds[at] if len(shorter) else 1, np.minimum(count, 1.0))
            contexts, inverse = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(inverse, weights=count), np.bincount(inverse)
            tables.append((key, np.maximum(count - DISCOUNT, 0) / total[inverse], contexts, DISCOUNT * kinds / total))
        for at, out_keys, out_values, missing in ((0, keys, gain, 0.0), (2, context_keys, weight, 1.0)):
            every = np.unique(np.concatenate([t[at] for t in tables]))
            values = np.full((len(every), len(languages)), missing)
            for j, t in enumerate(tables):
                values[np.searchsorted(every, t[at]), j] = t[at + 1]
            out_keys.append(every)
            out_values.append(values)
    return Model(languages, keys, gain, context_keys, weight, 1.0 / (len(alphabet) + 2), 8.0, float("inf"))


class Scorer:
    """Entropies of texts, with the runs met so far kept."""

    def __init__(self, model: Model, most_runs: int = 400_000):
        self.model, self.most = model, most_runs
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages) + 1))

    def _learn(self, runs: set[str]) -> None:
        if len(self.place) + len(runs) > self.most:
            self.place.clear()
            self.rows = self.rows[:0]
        new = sorted(runs - self.place.keys())
        parts = [self.rows]
        for at in range(0, len(new), 20_000):
            cost, n = self.model.entropies(new[at : at + 20_000])
            parts.append(np.column_stack([cost, n]))
        self.place.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.concatenate(parts)

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, posteriors and entropies per character of the best language."""
        runs = [_runs(text) for text in texts]
        every = set().union(*runs)
        if every - self.place.keys():
            self._learn(every if len(self.place) + len(every) > self.most else every - self.place.keys())
        get = self.place.__getitem__
        langs, score, entropy = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        for i, own in enumerate(runs):
            if own:
                total = self.rows[np.fromiter(map(get, own), dtype=np.int64, count=len(own))].sum(axis=0)
                h = total[:-1] / total[-1]
                best = int(h.argmin())
                langs[i], entropy[i] = self.model.languages[best], h[best]
                score[i] = _posterior(h[None, :], self.model.sharpness)[0, best]
        return langs, score, entropy


def fit(docs: DataFrame, labels: DataFrame, label: str = "lang", per_language: int = 400, max_bytes: int = 1 << 16) -> Model | None:
    """Learn from the texts of ``docs`` with a language in ``labels``: at most ``per_language`` for each, long ones cut."""
    rows, _ = bounded_sample(docs, labels, label, per_language, max_bytes, cut=True, most_bytes=64 << 20)
    return learn([(text, lang) for _, text, lang in rows])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score (posterior of that language), entropy, rejected."""
    shared = by_value(docs.sparkSession, model)  # bounded by the sample's size
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        scorer = held("langid", key, lambda: Scorer(model)) if model else None
        for batch in slices(batches, "text", 2_000_000):
            n = batch.num_rows
            langs, score, entropy = scorer.score(batch.column("text").to_pylist()) if scorer else (["und"] * n, np.zeros(n), np.zeros(n))
            rejected = [lang == "und" or h > model.reject_above for lang, h in zip(langs, entropy.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double, entropy double, rejected boolean")
