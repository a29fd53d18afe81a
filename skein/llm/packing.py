"""Best-fit packing by bin completion.

Documents become token sequences of at most ``capacity`` tokens. What a packing needs to know is how
many pieces there are of each length, and there are at most ``capacity`` lengths: that histogram goes to
the driver, whatever the corpus' size. There best fit gives the first incumbent. Where a bound from below
leaves room for a better one, a branch and bound over bin completions looks for it: undominated fillings
around the largest piece left, cut by the waste that one sequence less could afford. What comes out are
patterns (which lengths share a sequence, and how often), and a window rank within each length gives every
piece its place in a pattern. The search visits at most ``nodes`` nodes; ``Plan.proven`` says whether the
number of sequences is proven to be least.

Defined cases: null text counts as empty (one end token); repeated rows are pieces of their own; an empty
table gives no rows; equal lengths are dealt in the order of (salt, doc_id, piece, checksum); columns of
``place``'s input named sequence_id or offset are replaced, all others stay.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import held, materialize, slices, small_batches, unique_names
from skein.llm.words import WordIds

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint"
#: A hot length's pieces are ranked in so many groups, and more where a length has over SALTED pieces a group.
SALTS, SALTED = 64, 1_000_000


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit) and their crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = held("words", (tokenizer_path, 4), lambda: WordIds(tokenizer_path)), np.array([end_id], dtype="<u4").tobytes()
        step = capacity * 4
        for batch in slices(batches, "text"):
            columns: list[list] = [[], [], [], [], [], []]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                data = ids + end
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    for column, value in zip(columns, (doc_id, k, at // 4, len(part) // 4, part, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


@dataclass
class Pattern:
    """``count`` sequences, each with ``items``: (length, copies) in the order of their places."""

    count: int
    items: list[tuple[int, int]]


class _Supply:
    """Counts by length, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: n for k, n in counts.items() if n > 0}
        self.order = sorted(self.left)

    def take(self, items: list[tuple[int, int]], times: int) -> None:
        """Use ``items`` so often; negative times give them back."""
        for length, copies in items:
            before = self.left.get(length, 0)
            now = before - copies * times
            if now:
                self.left[length] = now
                if not before:
                    bisect.insort(self.order, length)
            else:
                del self.left[length]
                self.order.pop(bisect.bisect_left(self.order, length))

    def state(self) -> bytes:
        return hashlib.blake2b(repr(sorted(self.left.items())).encode(), digest_size=16).digest()


def _sums(items: Iterable[tuple[int, int]], room: int) -> Iterator[int]:
    """After each (length, copies): the sums up to ``room`` that some of the items so far make, as a bit set."""
    reach, every = 1, (1 << room + 1) - 1
    for length, copies in items:
        copies, step = min(copies, room // length), 1
        while copies > 0:  # binary splitting of the copies
            n = min(step, copies)
            reach |= reach << length * n & every
            copies, step = copies - n, step * 2
        yield reach


def _spread(bits: int, low: int, high: int) -> int:
    """Every bit moved up by each of ``low`` to ``high``."""
    if high < low:
        return 0
    out, width = bits << low, 1
    while width < high - low + 1:
        n = min(width, high - low + 1 - width)
        out |= out << n
        width += n
    return out


def _dominated(chosen: list[tuple[int, int]], spare: int, waste: int) -> bool:
    """Whether an item left out (``spare``: their lengths as bits) could take the place of some chosen ones that fit in it.

    Nothing chosen goes for an item no longer than the waste, and one item only for a longer one.
    """
    one, more = 0, 0
    for length, copies in chosen:
        for _ in range(copies):
            more |= (more | one) << length
            one |= 1 << length
    return bool(spare & (_spread(more, 0, waste) | _spread(one, 1, waste) | _spread(1, 1, waste)))


def _fillings(supply: _Supply, largest: int, capacity: int, waste: int) -> Iterator[list[tuple[int, int]]]:
    """The undominated fillings around one piece of length ``largest`` that waste at most ``waste``, full ones first.

    Lengths go in from large to small, and only where the lengths below can still make a sum that leaves
    little enough waste.
    """
    room = capacity - largest
    order = supply.order[: bisect.bisect_right(supply.order, room)]
    left = {k: supply.left[k] - (k == largest) for k in order}
    reach = [1, *_sums(((k, left[k]) for k in order), room)]

    def open_at(i: int, room: int, allowed: int) -> bool:
        low = max(0, room - allowed)
        return reach[i] >> low & (1 << room - low + 1) - 1 != 0

    def go(i: int, room: int, allowed: int) -> Iterator[list[tuple[int, int]]]:
        for j in range(min(i, bisect.bisect_right(order, room)), 0, -1):
            if not open_at(j, room, allowed):
                break
            length = order[j - 1]
            for copies in range(min(left[length], room // length), 0, -1):
                if open_at(j - 1, room - copies * length, allowed):
                    for rest in go(j - 1, room - copies * length, allowed):
                        yield [(length, copies), *rest]
        if room <= allowed:
            yield []

    for allowed in sorted({0, max(0, min(waste, room))}):
        for chosen in go(len(order), room, allowed):
            used = dict(chosen)
            over = room - sum(k * n for k, n in chosen)
            spare = sum(1 << k for k in order if left[k] > used.get(k, 0))
            if (over == 0) == (allowed == 0) and not _dominated(chosen, spare, over):
                yield chosen


def _least_waste(supply: _Supply, capacity: int) -> int:
    """What bins lose at least: each piece over half a bin has its own bin, filled by some sum of the others at best."""
    half = bisect.bisect_right(supply.order, capacity // 2)
    reach = 1
    for reach in _sums(((k, supply.left[k]) for k in supply.order[:half]), capacity):  # noqa: B007
        pass
    return sum(supply.left[k] * (capacity - k - (reach & (1 << capacity - k + 1) - 1).bit_length() + 1) for k in supply.order[half:])


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A bound from below: tokens and unavoidable waste over the fullest bin that the lengths can make."""
    supply = _Supply(counts)
    if not supply.order:
        return 0
    for reach in _sums(((k, supply.left[k]) for k in supply.order), capacity):  # noqa: B007
        pass
    tokens = sum(k * n for k, n in supply.left.items())
    large = sum(n for k, n in supply.left.items() if k > capacity // 2)
    return max(large, -(-tokens // (reach.bit_length() - 1)), -(-(tokens + _least_waste(supply, capacity)) // capacity))


def _complete(counts: dict[int, int], capacity: int, bins: int, nodes: list[int]) -> list[Pattern] | None:
    """A packing into ``bins`` bins, or None when there is none or ``nodes`` ran out.

    Branches are the undominated fillings around the largest piece left, taken as often as there are pieces
    for, then once. A branch ends when its waste and the least waste of what is left are more than ``bins``
    bins can lose, or when it leads to a state that has failed before.
    """
    supply, path, failed = _Supply(counts), [], {}
    slack = bins * capacity - sum(k * n for k, n in counts.items())

    def branches(slack: int) -> Iterator[tuple[Pattern, int]]:
        nodes[0] -= 1
        state = supply.state()
        if slack < 0 or failed.get(state, -1) >= slack or _least_waste(supply, capacity) > slack:
            return
        largest = supply.order[-1]
        for filling in _fillings(supply, largest, capacity, slack):
            waste = capacity - largest - sum(k * n for k, n in filling)
            copies = Counter({largest: 1})
            for length, n in filling:
                copies[length] += n
            items = list(copies.items())
            most = min(supply.left[k] // n for k, n in items)
            most = min(most, slack // waste) if waste else most
            for times in sorted({most, 1}, reverse=True):
                if times and nodes[0] > 0:
                    yield Pattern(times, items), slack - waste * times
        if nodes[0] > 0:
            failed[state] = max(slack, failed.get(state, -1))

    # a level that waits keeps how many of its branches were taken, not their generator: levels may be thousands
    stack, level = [[slack, 0]], branches(slack)
    while stack:
        if not supply.order:
            return list(path)
        if level is None:
            level = islice(branches(stack[-1][0]), stack[-1][1], None)
        step = next(level, None)
        if step is None:
            stack.pop()
            level = None
            if path:
                last = path.pop()
                supply.take(last.items, -last.count)
            continue
        stack[-1][1] += 1
        pattern, slack = step
        supply.take(pattern.items, pattern.count)
        path.append(pattern)
        stack.append([slack, 0])
        level = branches(slack) if supply.order else None
    return None


def _best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Largest first, then again and again the largest that still fits: the first incumbent."""
    supply, out = _Supply(counts), []
    while supply.order:
        chosen, room, i = Counter(), capacity, len(supply.order)
        while i and room >= supply.order[0]:
            i = min(i, bisect.bisect_right(supply.order, room))
            if i:
                length = supply.order[i - 1]
                n = 1 if not chosen else min(supply.left[length] - chosen[length], room // length)
                chosen[length] += n
                room -= n * length
                i -= len(chosen) > 1 or chosen[length] == supply.left[length]
        items = [(k, n) for k, n in chosen.items() if n]
        times = min(supply.left[k] // n for k, n in items)
        supply.take(items, times)
        out.append(Pattern(times, items))
    return out


@dataclass
class Plan:
    """``patterns`` hold every piece; no packing has fewer than ``bound`` sequences; ``proven``: nor fewer than this one."""

    patterns: list[Pattern]
    bound: int
    proven: bool

    @property
    def sequences(self) -> int:
        return sum(p.count for p in self.patterns)


def solve(counts: dict[int, int], capacity: int, nodes: int = 20_000) -> Plan:
    """Pack pieces, given as counts by length, into as few sequences as can be.

    Best fit is the first incumbent; while the bound allows one sequence less, bin completion looks for it.
    Up to ``nodes`` nodes of the search are visited; ``proven`` tells whether that sufficed.
    """
    best, bound, budget = _best_fit(counts, capacity), least_bins(counts, capacity), [nodes]
    while (size := sum(p.count for p in best)) > bound:
        better = _complete(counts, capacity, size - 1, budget)
        if better is None:
            return Plan(best, bound, budget[0] > 0)
        best = better
    return Plan(best, bound, True)


def plan(counts: dict[int, int], capacity: int, nodes: int = 20_000) -> list[Pattern]:
    """The patterns of ``solve``."""
    return solve(counts, capacity, nodes).patterns


def place(pieces: DataFrame, capacity: int = 4096, solved: Plan | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ids_crc32 and what else they hold)."""
    solved = solved or solve(_counts(pieces), capacity)
    counts: Counter = Counter()
    for p in solved.patterns:
        for length, copies in p.items:
            counts[length] += copies * p.count
    starts: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, copies, offset
    base, rank = 0, dict.fromkeys(counts, 0)
    for p in solved.patterns:
        offset = 0
        for length, copies in p.items:
            starts.append((length, rank[length], base, copies, offset))
            rank[length] += copies * p.count
            offset += length * copies
        base += p.count
    table = np.array(sorted(starts), dtype=np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(table)  # some rows for each of at most ``capacity`` lengths

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def put(length, rank):  # noqa: ANN001, ANN202
        import pandas as pd

        table = shared.value
        key = table[:, 0] * (1 << 40) + table[:, 1]
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = table[np.searchsorted(key, length * (1 << 40) + rank, side="right") - 1]
        at = rank - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + at // row[:, 3], "offset": row[:, 4] + at % row[:, 3] * length})

    salts = max(SALTS, -(-max(counts.values(), default=0) // SALTED))
    salt, rank, before, at = unique_names(pieces, "salt", "rank", "before", "at")
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    by_salt = salted.groupBy("length", salt).agg(F.count("*").alias("n"))
    first = by_salt.select("length", salt, (F.sum("n").over(Window.partitionBy("length").orderBy(salt)) - F.col("n")).alias(before))
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy("doc_id", "piece", "ids_crc32")) - 1)
    placed = ranked.join(first, ["length", salt]).withColumn(at, put("length", F.col(before) + F.col(rank)))
    kept = [F.col(c) for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    return placed.select(*kept, F.col(at)["sequence_id"].alias("sequence_id"), F.col(at)["offset"].alias("offset"))


def _counts(pieces: DataFrame) -> dict[int, int]:
    """Pieces by length: at most ``capacity`` rows."""
    return {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}


@dataclass
class Packed:
    """``pieces``: the stored token ids by piece; ``placement``: each piece's sequence and offset, without ids; ``plan``: what was solved."""

    pieces: DataFrame
    placement: DataFrame
    plan: Plan

    def sequences(self) -> DataFrame:
        """Per sequence the ids of its pieces in order, as one binary (at most ``capacity`` ids each)."""
        whole = self.placement.select("doc_id", "piece", "ids_crc32", "length", "sequence_id", "offset").join(
            self.pieces.select("doc_id", "piece", "ids_crc32", "length", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32", "length"]), ["doc_id", "piece", "ids_crc32", "length"]
        )
        parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
        return whole.groupBy("sequence_id").agg(F.unhex(F.concat_ws("", F.transform(parts, lambda x: x["ids"]))).alias("ids"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> Packed:
    """Tokenize, store the pieces in the shared folder, and place each one."""
    with small_batches(docs.sparkSession):
        pieces = materialize(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    solved = solve(_counts(pieces), capacity)
    return Packed(pieces, place(pieces.drop("ids"), capacity, solved), solved)
