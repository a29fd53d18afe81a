"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a perfect covering code: on each 23-bit slice of the fingerprint the binary Golay
code, whose balls of radius 3 fill the space. A fingerprint's home is its one nearest anchor; it also goes
to every anchor within the covering radius plus the threshold (on several slices: wherever the distances
beyond the radius sum to the threshold at most). Two fingerprints that differ in at most ``threshold`` bits
thus meet at each other's home. One slice gives 4,096 anchors, two give 16.7 million; the slices follow
from the number of distinct fingerprints, and the result doesn't depend on them. A 64-bit fingerprint has room for
no third slice: beyond some 10**12 distinct fingerprints two slices' anchors grow with the table.

At an anchor the fingerprints at home are held, in groups of bounded size, and the visitors stream past
them. What leaves an anchor is a spanning forest of its links, never all pairs; components of the forests
give the groups.

Defined cases: null and empty texts have fingerprint zero, linked like any other; texts of one or two
words have one shingle; repeated rows share a fingerprint and thus a group; a null doc_id is no group's
least id unless it is alone; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import held, materialize, slices, unique_names
from skein.llm.components import components

SLICE = 23
#: Generator polynomial of the binary Golay code (fixed value).
GENERATOR = 0b110001110101
#: At most so many home fingerprints are held at once; an anchor with more is split.
HELD = 1 << 16
#: Distinct fingerprints up to which one slice is used: it has fewer visits, two slices have smaller anchors.
ONE_SLICE = 1 << 21
#: Fingerprints in a task that replicates them.
DEALT = 100_000


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the shingles' XXH64, as an unsigned 64-bit number."""
    import xxhash

    own = (text or "").encode().lower().split()  # on bytes: A-Z, and 0x20 with 0x09 to 0x0D
    if not own:
        return 0
    joined = b" ".join(own)
    if len(own) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
    shingles = [joined[a:b] for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(seed))), dtype=np.uint8)).reshape(-1, 64)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t, words, seed) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


class Golay:
    """Homes and visits on one slice. An anchor's number is its code word's upper 12 bits."""

    def __init__(self, threshold: int):
        x = np.arange(1 << 12, dtype=np.int64)
        self.codes = np.zeros(1 << 12, dtype=np.int64)
        for i in range(12):
            self.codes ^= np.where(x >> i & 1, GENERATOR << i, 0)
        self.low, self.high = self._remainders(np.arange(1 << 12)), self._remainders(np.arange(1 << 11) << 12)
        leaders = np.zeros(1 << 11, dtype=np.int64)
        for n in range(1, 4):
            for flips in combinations(range(SLICE), n):
                e = sum(1 << f for f in flips)
                leaders[self._remainders(np.array([e]))[0]] = e
        self.leaders = leaders
        starts, words, beyond = [0], [], []
        for e in leaders:
            d = np.bitwise_count(self.codes ^ e).astype(np.int64)
            near = np.flatnonzero(d <= 3 + threshold)
            words.append(self.codes[near])
            beyond.append(np.maximum(d[near] - 3, 0))
            starts.append(starts[-1] + len(near))
        self.starts, self.words, self.beyond = np.array(starts), np.concatenate(words), np.concatenate(beyond)

    @staticmethod
    def _remainders(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64).copy()
        for i in range(SLICE - 1, 10, -1):
            x ^= np.where(x >> i & 1, GENERATOR << (i - 11), 0)
        return x

    def homes(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code words nearest to ``y`` and the syndromes."""
        s = self.low[y & 0xFFF] ^ self.high[y >> 12]
        return y ^ self.leaders[s], s

    def visits(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into y, anchor number, distance beyond the covering radius) of every anchor in reach."""
        home, s = self.homes(y)
        n = self.starts[s + 1] - self.starts[s]
        row = np.repeat(np.arange(len(y)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[s], n)
        return row, (home[row] ^ self.words[at]) >> 11, self.beyond[at]


def _anchors(code: Golay, fps: np.ndarray, threshold: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchor of each fingerprint, and (index, anchor) of all its visits, home included."""
    home = np.zeros(len(fps), dtype=np.int64)
    row, anchor, beyond = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64), np.zeros(len(fps), dtype=np.int64)
    for k in range(parts):
        y = (fps >> np.uint64(SLICE * k) & np.uint64((1 << SLICE) - 1)).astype(np.int64)
        home = home << 12 | code.homes(y)[0] >> 11
        r, a, b = code.visits(y)
        n = np.bincount(r, minlength=len(fps))
        first = np.cumsum(n) - n
        # extend every visit so far by every visit on this slice
        m = n[row]
        src = np.repeat(np.arange(len(row)), m)
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[row], m)
        total = beyond[src] + b[at]
        keep = total <= threshold
        row, anchor, beyond = row[src][keep], (anchor[src] << 12 | a[at])[keep], total[keep]
    return home, row, anchor


def _blobs(anchor: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    order = np.argsort(anchor, kind="stable")
    names, first = np.unique(anchor[order], return_index=True)
    data = fps[order]
    return names, [x.tobytes() for x in np.split(data, first[1:])] if len(names) else []


def replicate(distinct: DataFrame, threshold: int, parts: int) -> DataFrame:
    """(anchor, visitor 0/1, fps): by anchor and batch, the fingerprints at home and those in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = held("golay", threshold, lambda: Golay(threshold))
        step = 20_000 if parts == 1 else 2_000
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), step):
                fps = every[at : at + step]
                home, row, anchor = _anchors(code, fps, threshold, parts)
                for kind, (names, blobs) in enumerate((_blobs(home, fps), _blobs(anchor, fps[row]))):
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.full(len(names), kind), pa.int32()), pa.array(blobs, pa.binary())], names=["anchor", "visitor", "fps"])

    return distinct.select("fp").mapInArrow(run, "anchor bigint, visitor int, fps binary")


class Anchor:
    """The held fingerprints of one anchor (or a part of them), with the components found so far."""

    def __init__(self, fps: np.ndarray, threshold: int):
        self.fps, self.threshold, self.root = fps, threshold, np.arange(len(fps))

    def meet(self, visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compare with visitors; returns for each linked visitor one held fingerprint of its component."""
        out_a, out_b = [], []
        step = max(1, (1 << 21) // max(1, len(self.fps)))
        for at in range(0, len(visitors), step):
            part = visitors[at : at + step]
            i, j = np.nonzero(np.bitwise_count(self.fps[:, None] ^ part[None, :]) <= self.threshold)
            if not len(i):
                continue
            low = np.full(len(part), len(self.fps))
            while True:  # the least root over every link, until nothing moves
                np.minimum.at(low, j, self.root[i])
                moved = self.root.copy()
                np.minimum.at(moved, self.root[i], low[j])
                while (moved != (jumped := moved[moved])).any():
                    moved = jumped
                if (moved == self.root).all():
                    break
                self.root = moved[self.root]
            linked = low < len(self.fps)
            out_a.append(part[linked])
            out_b.append(self.fps[low[linked]])
        a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in (out_a, out_b))
        return a[a != b], b[a != b]

    def inner(self) -> tuple[np.ndarray, np.ndarray]:
        moved = self.root != np.arange(len(self.fps))
        return self.fps[moved], self.fps[self.root[moved]]


def links(distinct: DataFrame, threshold: int = 3, parts: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints: a spanning forest at every anchor."""
    n = distinct.count()
    if parts is None:
        parts = 1 if n <= ONE_SLICE else 2
    # a fingerprint becomes some seventy visits (hundreds on two slices): deal them out by their number first
    tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, -(-n // DEALT))
    spread = materialize(replicate(distinct.select("fp").repartition(tasks), threshold, parts), "anchors")
    at_home = spread.where("visitor = 0").groupBy("anchor").agg(F.sum(F.octet_length("fps") / 8).alias("n"))
    crowded = at_home.where(F.col("n") > HELD).select("anchor", F.ceil(F.col("n") * 2 / HELD).cast("int").alias("groups"))
    dealt = spread.join(crowded, "anchor", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    part = F.when(F.col("visitor") == 0, F.array(F.pmod(F.xxhash64("fps"), "groups").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("groups") - 1))
    dealt = dealt.select("anchor", F.explode(part).alias("part"), "visitor", "fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, anchor = None, [], None

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        found: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for name, group, visitor, blob in zip(*(batch.column(c).to_pylist() for c in ("anchor", "part", "visitor", "fps")), strict=True):
                if (name, group) != key:
                    if anchor is not None:
                        found.append(anchor.inner())
                    key, waiting, anchor = (name, group), [], None
                fps = np.frombuffer(blob, dtype=np.uint64)
                if not visitor:
                    waiting.append(fps)
                    continue
                if anchor is None:
                    anchor = Anchor(np.concatenate(waiting) if waiting else np.zeros(0, dtype=np.uint64), threshold)
                if len(anchor.fps):
                    found.append(anchor.meet(fps))
            if sum(len(a) for a, _ in found) > 50_000:
                yield out(*(np.concatenate(x) for x in zip(*found, strict=True)))
                found = []
        if anchor is not None:
            found.append(anchor.inner())
        if found:
            yield out(*(np.concatenate(x) for x in zip(*found, strict=True)))

    ordered = dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "visitor")
    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, threshold: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, fp and component_id, the smallest doc_id reachable over links."""
    prints = materialize(fingerprints(docs, words, seed), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct, threshold))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, words: int = 3, seed: int = 42, threshold: int = 3) -> DataFrame:
    """One row of each group of ``docs``, with all its columns: the smallest doc_id, then the first stored.

    Rows are told apart by a number fixed in a stored table, so repeated and null ids are no trouble.
    """
    row, fp = unique_names(docs, "row", "fp")
    print_of = fingerprinter(words, seed)
    kept = materialize(docs.withColumn(fp, print_of(F.col("text").cast("string"))).withColumn(row, F.monotonically_increasing_id()), "rows")
    prints = kept.select(F.col(fp).alias("fp"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row")).alias("at"))
    distinct = materialize(prints.groupBy("fp").agg(F.min("at").alias("at")), "distinct")
    roots = components(links(distinct, threshold))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(F.coalesce("root", "fp").alias("root"), "at")
    first = rooted.groupBy("root").agg(F.min("at").alias("at")).select(F.col("at.row").alias("first"))
    dropped = kept.select(F.col(row).alias("first")).join(first, "first", "left_anti")
    return kept.join(dropped, kept[row] == dropped["first"], "left_anti").select(*docs.columns)


def fingerprinter(words: int = 3, seed: int = 42):  # noqa: ANN201
    """``fingerprint`` as a function of a text column, as a signed long."""

    @F.pandas_udf("bigint")
    def of(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(np.array([fingerprint(t, words, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return of
