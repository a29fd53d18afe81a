"""The change stream: a debouncer with a cap as a stateful operator, a routed refresh with a kept status, retries and leases.

``sources.listing`` gives the changes of folders that send no events.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from skein.operators.changes import MOST_BYTES, MOST_PATHS
from skein.operators.storage import Files

OUTPUT = "key string, started timestamp, closed timestamp, event_count bigint, paths array<string>, full_rescan boolean, overflow_count bigint"
STATE = "opened bigint, last bigint, event_count bigint, paths array<string>, bytes bigint, full_rescan boolean, overflow_count bigint"


class Batch:
    """An open batch; its list of paths is bounded, beyond the bound it is a full rescan."""

    def __init__(self, state: tuple | None, most_paths: int, most_bytes: int):
        self.limits = most_paths, most_bytes
        if state:
            self.opened, self.last, self.count, paths, self.bytes, self.rescan, self.overflow = state
            self.paths = dict.fromkeys(paths)
        else:
            self.start(None)

    def start(self, at: int | None) -> None:
        self.opened, self.last, self.count, self.bytes, self.rescan, self.overflow = at, at, 0, 0, False, 0
        self.paths: dict[str, None] = {}

    def add(self, at: int, path: str, rescan: bool) -> None:
        self.last, self.count = at, self.count + 1
        if rescan:
            self.rescan = True
        if self.rescan:
            self.paths, self.bytes = {}, 0
        elif path not in self.paths:
            self.paths[path] = None
            self.bytes += len(path.encode())
            if len(self.paths) > self.limits[0] or self.bytes > self.limits[1]:
                self.rescan, self.overflow, self.paths, self.bytes = True, self.overflow + 1, {}, 0

    def row(self, key: str, closed: int) -> Row:
        micros = lambda t: datetime.fromtimestamp(t // 1_000_000, UTC) + timedelta(microseconds=t % 1_000_000)
        return Row(key=key, started=micros(self.opened), closed=micros(closed), event_count=self.count, paths=sorted(self.paths), full_rescan=self.rescan, overflow_count=self.overflow)

    def state(self) -> tuple:
        return self.opened, self.last, self.count, list(self.paths), self.bytes, self.rescan, self.overflow


class Debouncer(StatefulProcessor):
    """One key's open batch, and its events that the watermark hasn't passed, by their millisecond.

    Every event sets timers at its own time and where a batch may end for it. Timers fire in the order of time once the watermark has passed them, so events
    are taken in order however they came, a millisecond's events at a time: neither a key's rows of a micro-batch nor
    its waiting events are ever together in memory.
    """

    def __init__(self, gap: int, wait: int, most_paths: int, most_bytes: int):
        self.gap, self.wait, self.limits = gap, wait, (most_paths, most_bytes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)
        self.waiting = handle.getMapState("waiting", "ms bigint", "events array<struct<at:bigint,path:string,rescan:boolean>>")

    def _keep(self, fresh: dict[int, list[tuple]]) -> None:
        for ms, events in fresh.items():
            if self.waiting.containsKey((ms,)):
                events = [*map(tuple, self.waiting.getValue((ms,))[0]), *events]
            self.waiting.updateValue((ms,), (events,))
            for at in {ms} | {(e[0] + after) // 1000 + 1 for e in events for after in (self.gap, self.wait)}:
                self.handle.registerTimer(at)
        fresh.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803  Spark's names
        fresh: dict[int, list[tuple]] = {}
        for n, r in enumerate(rows, start=1):
            fresh.setdefault(r["at"] // 1000, []).append((r["at"], r["path"], bool(r["rescan"])))
            if n % 1000 == 0:
                self._keep(fresh)
        self._keep(fresh)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802
        ms, out = expiredTimerInfo.getExpiryTimeInMs(), []
        batch = Batch(tuple(self.open.get()) if self.open.exists() else None, *self.limits)
        end = lambda: min(batch.last + self.gap, batch.opened + self.wait)
        if self.waiting.containsKey((ms,)):
            for at, path, rescan in sorted(map(tuple, self.waiting.getValue((ms,))[0])):
                if batch.opened is not None and at >= end():
                    out.append(batch.row(key[0], end()))
                    batch.start(None)
                if batch.opened is None:
                    batch.start(at)
                batch.add(at, path, rescan)
            self.waiting.removeKey((ms,))
        if batch.opened is not None and end() // 1000 < ms:
            out.append(batch.row(key[0], end()))
            batch.start(None)
        if batch.opened is None:
            self.open.clear()
        else:
            self.open.update(batch.state())
        return iter(out)

    def close(self) -> None:
        pass


def debounce(events: DataFrame, debounce_seconds: float, max_wait_seconds: float, watermark: str = "0 seconds", most_paths: int = MOST_PATHS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Batches of a stream of (key, ts timestamp, path, rescan): closed at min(last + debounce, opened + max_wait).

    The same batches as ``changes.capped`` gives, whatever the order in which events come within the watermark; later ones are
    dropped. The state must be kept by RocksDB (``with_rocksdb``).
    """
    rows = events.withColumn("at", F.unix_micros("ts")).where("at is not null").withWatermark("ts", watermark)
    step = Debouncer(int(debounce_seconds * 1_000_000), int(max_wait_seconds * 1_000_000), most_paths, most_bytes)
    return rows.groupBy("key").transformWithState(step, OUTPUT, "append", "EventTime")


def with_rocksdb(spark: SparkSession) -> None:
    """Let the session's streams keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def session_batches(events: DataFrame, gap: str, watermark: str = "0 seconds") -> DataFrame:
    """Debouncing without a cap: Spark's own session windows."""
    return events.withWatermark("ts", watermark).groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("event_count")).select("key", F.col("w.start").alias("started"), F.col("w.end").alias("closed"), "event_count")


def with_retry(action: Callable[[], object], transient: Callable[[Exception], bool], attempts: int = 5, first: float = 0.1, most: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """Repeat while errors are transient, waiting twice as long each time."""
    wait = first
    for n in range(attempts):
        try:
            return action()
        except Exception as e:  # noqa: BLE001  the caller's test decides
            if n + 1 == attempts or not transient(e):
                raise
            sleep(wait)
            wait = min(wait * 2, most)
    return None


class Coordinator:
    """One refresh at a time; paths that come meanwhile wait together, and stale tickets are ignored."""

    def __init__(self) -> None:
        self.active: int | None = None
        self.sequence = 0
        self.pending: set[str] = set()

    def submit(self, paths: set[str]) -> tuple[int, set[str]] | None:
        self.pending |= paths
        if self.active is not None or not self.pending:
            return None
        self.sequence += 1
        self.active, work = self.sequence, set(self.pending)
        self.pending.clear()
        return self.active, work

    def finish(self, ticket: int) -> bool:
        if ticket != self.active:
            return False
        self.active = None
        return True


class Status:
    """What a refresh stream has done, kept in a folder beside its checkpoint: a restarted stream goes on counting.

    Each epoch is a file of its own that is created once, so a replayed epoch neither counts nor publishes again. The oldest
    files are folded into a total now and then.
    """

    def __init__(self, spark: SparkSession, root: str, fold: int = 100):
        self.spark, self.root, self.most = spark, root, fold

    @property
    def files(self) -> Files:
        return Files(self.spark, self.root)

    def _total(self) -> dict:
        files = self.files
        names = files.names("totals")
        return json.loads(files.read(f"totals/{names[-1]}")) if names else {"epoch": -1}

    def read(self) -> dict:
        """Counts over all epochs, the last ``epoch``, and the ``error`` of the last one if it failed."""
        files, out = self.files, self._total()
        for name in files.names("epochs"):
            if int(name) > out["epoch"]:
                counts = files.read(f"epochs/{name}") or "{}"  # it may be being written
                out = self._added(out, json.loads(counts) | {"epoch": int(name)})
        names = files.names("errors")
        if names and int(names[-1]) > out["epoch"]:
            out["error"] = files.read(f"errors/{names[-1]}")
        return out

    @staticmethod
    def _added(total: dict, more: dict) -> dict:
        return {k: more[k] if k == "epoch" else total.get(k, 0) + more.get(k, 0) for k in {**total, **more}}

    def done(self, epoch: int) -> bool:
        return epoch <= self._total()["epoch"] or self.files.exists(f"epochs/{epoch:012d}")

    def record(self, epoch: int, **counts: int) -> bool:
        """Count an epoch; False if it has been counted."""
        first = self.files.create(f"epochs/{epoch:012d}", json.dumps(counts))
        if first and len(self.files.names("epochs")) > self.most:
            self._fold()
        return first

    def failed(self, epoch: int, error: Exception) -> None:
        self.files.replace(f"errors/{epoch:012d}", f"{type(error).__name__}: {error}"[:1000])

    def _fold(self) -> None:
        files, total = self.files, self.read()
        total.pop("error", None)
        if files.create(f"totals/{total['epoch']:012d}", json.dumps(total)):
            for name in files.names("epochs"):
                if int(name) <= total["epoch"]:
                    files.delete(f"epochs/{name}")
            for name in files.names("totals")[:-1]:
                files.delete(f"totals/{name}")


def refresher(plan: Callable[[DataFrame], DataFrame], publish: Callable[[DataFrame], None], status: Status, transient: Callable[[Exception], bool] = lambda e: False) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: plan a micro-batch's changes, publish unless there are none, and keep counts.

    A publication that ended before its epoch was recorded is made again at restart; it should be one that equal
    content doesn't change, as ``generations.Store.publish`` with a digest is.
    """

    def each(batches: DataFrame, epoch: int) -> None:
        if status.done(epoch):  # a replayed batch has been published
            return
        changes = plan(batches).persist()
        try:
            n = changes.count()
            if n:
                with_retry(lambda: publish(changes), transient)
            status.record(epoch, published=int(n > 0), suppressed=int(not n), changes=n)
        except Exception as e:
            status.failed(epoch, e)
            raise
        finally:
            changes.unpersist()

    return each


OBSERVED = "refresh"


def observed(batches: DataFrame) -> DataFrame:
    """``debounce``'s batches with their counts as metrics, which Spark gathers while the rows go by."""
    paths = F.coalesce(F.sum(F.size("paths")), F.lit(0))
    return batches.observe(OBSERVED, F.count("*").alias("batches"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("events"), paths.alias("paths"), F.count_if("full_rescan").alias("rescans"), F.coalesce(F.sum("overflow_count"), F.lit(0)).alias("overflows"))


class Watcher(StreamingQueryListener):
    """Records what ``observed`` streams report; ``spark.streams.addListener(Watcher(status))``."""

    def __init__(self, status: Status):
        self.status = status

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802  Spark's names
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        found = event.progress.observedMetrics.get(OBSERVED)
        if found is not None:
            self.status.record(event.progress.batchId, **found.asDict())

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass


def route(paths: DataFrame, roots: list[str], generated: str = ".astro") -> DataFrame:
    """Where a path's change goes: graph, wiki, both, or nowhere for generated files."""
    inside = F.lit(False)
    for root in roots:
        inside = inside | F.col("path").startswith(root.rstrip("/") + "/")
    made = F.array_contains(F.split("path", "/"), generated)
    markdown = F.col("path").rlike(r"\.mdx?$")
    source = F.col("path").rlike(r"\.(py|rs|go|c|h|cc|cpp|cxx|hpp|hh|f|f90|f95|for)$")
    to = F.when(made, None).when(inside & markdown, "both").when(inside, "wiki").when(source | markdown, "graph")
    return paths.select("path", to.alias("consumer")).where("consumer is not null")


#: What messages of errors that pass by themselves say (fixed values).
TRANSIENT = ("could not set lock", "lock is held", "database is locked", "database busy", "resource busy", "couldn't replay shadow pages", "read-only mode")


def is_transient(error: Exception) -> bool:
    """Whether another attempt may succeed, by the error's message."""
    message = str(error).lower()
    return any(part in message for part in TRANSIENT)
