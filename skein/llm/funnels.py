"""Ordered funnels over event streams, by regular expressions over session strings.

Rows of one client and one time collapse into a symbol for their set of kinds. A client's symbols in order of time
make strings, cut where a gap is longer than the window: no attempt crosses it. Every symbol that holds a funnel's
first kind opens an attempt; behind it a lookahead takes, for each further step, the earliest symbol with the
step's kind, over symbols with neither that kind nor an excluded one. Matches overlap, so every attempt is found, and
the captured positions give the times, which must lie within the window.

A client's time is dealt in ``slice`` lengths, by (client, slice) to the tasks, and the first window of each slice is
copied to the end of the one before, where it may be reached but opens no attempt. So an attempt sees all it can
reach, and the rows of a client with any share of the table spread over all tasks. A task holds one slice at a time
beyond its Arrow batch: as much as a client's events in ``slice`` plus window.

Percentiles are picked by radix: counts per (funnel, client, step, wait) are made once and stored; sums over the high
half of a wait's bits name the part that holds the wanted rank, counts within that part the wait. A group then
has at most some 2**(bits/2) rows in either pass, however many attempts are behind it.

Defined cases: rows with a null client, kind or time are no events; repeated rows count once; kinds in no funnel
are ignored; a step needs a strictly later time than the one before, so several kinds of one time are one place; an
excluded kind at the time of the next step blocks it, at the time of the previous step it doesn't; a funnel may
repeat a kind; an empty table gives no rows; extra columns are ignored. At most 11 kinds can be told apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from skein.llm.common import materialize

MINUTE = 60_000_000
#: The first symbol; the sets of kinds follow, then those of rows that only may be reached.
BASE, BREAK = 0x100, ord("\n")


@dataclass(frozen=True)
class Funnel:
    name: str
    steps: tuple[str, ...]
    excluding: tuple[str, ...] = ()


def micros(frame: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is counted on its own clock, whatever the session's zone is."""
    at = F.col(column)
    if not isinstance(frame.schema[column].dataType, TimestampNTZType):
        return F.unix_micros(at.cast("timestamp"))
    days = F.unix_date(at.cast("date")).cast("bigint")
    seconds = (days * 24 + F.hour(at)) * 3600 + F.minute(at) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("bigint")


def expression(funnel: Funnel, kinds: Sequence[str]) -> str:
    """The funnel over symbols: a group a step, the later ones in a lookahead."""
    sets = 1 << len(kinds)

    def symbols(wanted, own_only: bool = False) -> str:  # noqa: ANN001
        held = [s for s in range(sets) if wanted({k for i, k in enumerate(kinds) if s >> i & 1})]
        return "[" + "".join(chr(BASE + s + shift) for shift in ((0,) if own_only else (0, sets)) for s in held) + "]"

    barred, tail = set(funnel.excluding), ""
    for step in reversed(funnel.steps[1:]):
        if step in barred:
            break_here = "(?!)()"  # never reached: it is excluded itself
            tail = f"(?:{break_here}{tail})?"
            continue
        over = symbols(lambda held, step=step: step not in held and not held & barred)
        here = symbols(lambda held, step=step: step in held and not held & barred)
        tail = f"(?:{over}*+({here}){tail})?"
    return f"({symbols(lambda held: funnel.steps[0] in held, own_only=True)})(?={tail})"


def session_strings(client: np.ndarray, piece: np.ndarray, at: np.ndarray, kinds: np.ndarray, window: int, n_kinds: int, width: int) -> tuple[str, np.ndarray, np.ndarray]:
    """Sorted rows as one string of sessions, and the row (time and client) behind each of its places.

    ``piece`` is the slice a row is dealt to; rows of another slice's time only may be reached.
    """
    first = np.concatenate([[True], (client[1:] != client[:-1]) | (piece[1:] != piece[:-1]) | (at[1:] != at[:-1])])
    starts = np.flatnonzero(first)
    sets = np.bitwise_or.reduceat(kinds, starts)
    client, piece, at = client[starts], piece[starts], at[starts]
    begins = np.concatenate([[False], (client[1:] != client[:-1]) | (piece[1:] != piece[:-1]) | (at[1:] - at[:-1] > window)])
    places = np.arange(len(starts)) + np.cumsum(begins)  # a break before each session but the first
    codes = np.full(places[-1] + 1, BREAK, dtype="<u4")
    codes[places] = BASE + sets + np.where(at // width == piece, 0, 1 << n_kinds)
    rows = np.zeros(len(codes), dtype=np.int64)
    rows[places] = np.arange(len(starts))
    return codes.tobytes().decode("utf-32-le"), at[rows], client[rows]


def attempts(events: DataFrame, funnels: Sequence[Funnel], window: int, client: str = "client_id", kind: str = "kind", at: str = "arrived_at", slice: int | None = None) -> DataFrame:
    """A row per attempt: funnel, client, started (microseconds since 1970) and waits, the microseconds from step to step.

    An attempt reached ``size(waits) + 1`` steps. ``window`` and ``slice`` are microseconds; a slice is three windows
    unless said otherwise. The client must be a whole number.
    """
    kinds = sorted({k for f in funnels for k in (*f.steps, *f.excluding)})
    if len(kinds) > 11:
        raise ValueError("at most 11 kinds can be told apart")
    if any(not f.steps for f in funnels):
        raise ValueError("a funnel has a step at least")
    width = slice or 3 * window
    if width < window:
        raise ValueError("a slice is as long as the window at least")
    openers = {f.steps[0] for f in funnels}
    bit = F.create_map(*(F.lit(x) for i, k in enumerate(kinds) for x in (k, 1 << i)))
    rows = events.where(F.col(client).isNotNull() & F.col(at).isNotNull() & F.col(kind).isin(kinds))
    rows = rows.select(F.col(client).cast("bigint").alias("client"), micros(events, at).alias("at"), bit[F.col(kind)].alias("bit"))
    own = F.floor(F.col("at") / F.lit(width)) if width >= 1 << 53 else F.expr(f"at div {width} - int(at % {width} < 0)")
    dealt = rows.withColumn("own", own.cast("bigint"))
    reached = F.col("at") - F.col("own") * width < window
    dealt = dealt.select("client", "at", "bit", F.explode(F.when(reached, F.array("own", F.col("own") - 1)).otherwise(F.array("own"))).alias("piece"))
    dealt = dealt.repartition("client", "piece").sortWithinPartitions("client", "piece", "at")
    expressions, names, n_kinds = [expression(f, kinds) for f in funnels], [f.name for f in funnels], len(kinds)
    can_open = sum(1 << i for i, k in enumerate(kinds) if k in openers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        patterns = [regex.compile(e) for e in expressions]
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[3] != rows[3, -1]))
            cut = last[-1] + 1 if len(last) else 0  # the slice at the end may go on in the next batch
            if held and (cut or held[0][0, 0] != rows[0, 0] or held[0][3, 0] != rows[3, 0]):
                yield from found(patterns, np.concatenate([*held, rows[:, :cut]], axis=1))
                held = []
            elif cut:
                yield from found(patterns, rows[:, :cut])
            held.append(rows[:, cut:])
        if held:
            yield from found(patterns, np.concatenate(held, axis=1))

    def found(patterns: list, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        client, at, bits, piece = rows
        if not (bits & can_open).any():
            return
        text, times, clients = session_strings(client, piece, at, bits, window, n_kinds, width)
        for name, pattern in zip(names, patterns, strict=True):
            spans = np.array([m.regs for m in pattern.finditer(text, overlapped=True)], dtype=np.int64)
            if not len(spans):
                continue
            places = spans[:, 1:, 0]  # of the steps; -1 where one isn't reached
            steps = np.where(places >= 0, times[places], np.iinfo(np.int64).max)
            reached = np.cumprod((places >= 0) & (steps - steps[:, :1] <= window), axis=1, dtype=np.int64)[:, 1:].astype(bool)
            waits = np.diff(steps, axis=1)[reached]
            ends = np.concatenate([[0], np.cumsum(reached.sum(axis=1))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(waits, pa.int64()))
            columns = [pa.array([name] * len(spans), pa.string()), pa.array(clients[places[:, 0]], pa.int64()), pa.array(steps[:, 0], pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["funnel", "client", "started", "waits"])

    return dealt.select("client", "at", "bit", "piece").mapInArrow(run, "funnel string, client bigint, started bigint, waits array<bigint>")


def step_waits(found: DataFrame) -> DataFrame:
    """Attempts by (funnel, client, step, wait) with their number ``n``; the first step's wait is 0."""
    steps = found.select("funnel", "client", F.posexplode(F.concat(F.array(F.lit(0).cast("bigint")), "waits")).alias("step", "wait"))
    return steps.withColumn("step", F.col("step") + 1).groupBy("funnel", "client", "step", "wait").agg(F.count("*").alias("n"))


def percentiles(counts: DataFrame, window: int, percent: int) -> DataFrame:
    """funnel, client, step, ``total`` attempts that reached it, and ``wait``: the ceil(percent * total / 100)-th smallest.

    ``counts`` is read twice, so it should be stored. No wait is longer than ``window``.
    """
    half = 1 << (window.bit_length() + 1) // 2
    group = ["funnel", "client", "step"]
    counts = counts.withColumn("high", F.expr(f"wait div {half}"))
    high = counts.groupBy(*group, "high").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*group)
    high = high.withColumns({"total": F.sum("n").over(whole), "upto": F.sum("n").over(whole.orderBy("high").rowsBetween(Window.unboundedPreceding, 0))})
    rank = F.expr(f"(total * {percent} + 99) div 100")
    high = high.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)).select(*group, "high", "total", (rank - (F.col("upto") - F.col("n"))).alias("rank"))
    low = counts.hint("merge").join(high.hint("merge"), [*group, "high"])  # neither side is bounded, so no broadcast
    order = Window.partitionBy(*group, "high").orderBy("wait").rowsBetween(Window.unboundedPreceding, 0)
    low = low.withColumn("upto", F.sum("n").over(order))
    return low.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select(*group, "total", "wait")


def funnel_counts(events: DataFrame, funnels: Sequence[Funnel], window: int = 5 * MINUTE, percent: int = 25, client: str = "client_id", kind: str = "kind", at: str = "arrived_at", slice: int | None = None) -> DataFrame:
    """A row per funnel and client with attempts: funnel, client, n1.. (attempts that reached each step), deepest,
    t2.. (the wait at ``percent`` of those that reached a step), same_depth (clients with equal funnel and deepest).
    """
    depth = max(len(f.steps) for f in funnels)
    counts = materialize(step_waits(attempts(events, funnels, window, client, kind, at, slice)), "waits")
    picked = percentiles(counts, window, percent)
    reached = {f"n{k}": F.coalesce(F.sum(F.when(F.col("step") == k, F.col("total"))), F.lit(0)).alias(f"n{k}") for k in range(1, depth + 1)}
    waits = [F.sum(F.when(F.col("step") == k, F.col("wait"))).alias(f"t{k}") for k in range(2, depth + 1)]
    rows = materialize(picked.groupBy("funnel", "client").agg(*reached.values(), F.max("step").cast("int").alias("deepest"), *waits), "funnels")
    depths = rows.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))  # a row per funnel and step: bounded
    return rows.join(F.broadcast(depths), ["funnel", "deepest"])
