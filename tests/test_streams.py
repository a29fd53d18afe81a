"""Streams with state, restarts and replays, against the batch forms."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.operators import changes
from skein.sources.listing import Listing
from skein.streaming import refresh

EVENT = "key string, ts timestamp, event_id long, path string, rescan boolean"
BASE = datetime(2026, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    refresh.with_rocksdb(spark)


def drain(stream, checkpoint, name, rows):
    """Run until all input is taken, adding each batch's rows."""
    query = stream.writeStream.queryName(name).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).foreachBatch(lambda df, n: rows.extend((n, *r) for r in df.collect())).start()
    query.awaitTermination()


def test_debounced_stream_equals_the_batch_and_survives_restarts(spark, tmp_path):
    rng, t, events = random.Random(3), 0.0, []
    for i in range(120):
        t += rng.choice([0, 0.0004, 0.5, 1, 2, 4.9, 5, 5.0001, 12])
        events.append(("k", BASE + timedelta(seconds=t), i, f"p{rng.randrange(4)}", rng.random() < 0.05))
    events.insert(5, ("other", BASE + timedelta(seconds=3), 500, "x", False))
    end = BASE + timedelta(seconds=t + 1000)
    expected = changes.coalesce_batches(changes.capped(spark.createDataFrame(events, EVENT), 5, 20), most_paths=3).select("key", "started", "event_count", "paths", "full_rescan").collect()
    (tmp_path / "in").mkdir()
    parts = [events[:40], events[40:80], events[80:], [("last", end, 999, "z", False)]]
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows: list = []
    for n, part in enumerate(parts):
        rng.shuffle(part)  # in any order within a file
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drain(refresh.debounce(stream, 5, 20, "10 seconds", most_paths=3), tmp_path / "c", f"d{n}", rows)  # a new query each time
    found = sorted((r[1], r[2], r[4], r[5], r[6]) for r in rows)
    assert found == sorted(tuple(r) for r in expected)


def listed(spark, tmp_path):
    spark.dataSource.register(Listing)
    return spark.readStream.format("listing").option("path", str(tmp_path / "watched")).option("state", str(tmp_path / "state")).option("shards", 3).load()


def test_a_listing_stream_restarts_without_losing_or_repeating(spark, tmp_path):
    watched, rows = tmp_path / "watched", []
    (watched / "d").mkdir(parents=True)
    put = lambda name, text: (watched / name).write_text(text)
    put("a.py", "1")
    put("d/b.py", "1")

    def run(name):
        rows.clear()
        drain(listed(spark, tmp_path).select("path", "change", "byte_len"), tmp_path / "c", name, rows)
        return sorted((r[1], r[2]) for r in rows)

    assert run("l0") == []  # begins with the files as they are
    put("a.py", "22")
    put("c.py", "1")
    assert run("l1") == [("a.py", "changed"), ("c.py", "created")]
    assert run("l2") == []
    os.remove(watched / "d/b.py")  # while nothing runs
    put("c.py", "333")
    query = listed(spark, tmp_path).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, n: 1 / 0).start()
    with pytest.raises(Exception):  # noqa: B017  the batch fails and is not finished
        query.awaitTermination()
    put("e.py", "1")
    found = run("l3")
    assert found[:2] == [("c.py", "changed"), ("d/b.py", "deleted")] and set(found[2:]) <= {("e.py", "created")}
    assert ("e.py", "created") in found or run("l4") == [("e.py", "created")]


def test_status_is_kept_and_replays_count_once(spark, tmp_path):
    published = []
    status = refresh.Status(spark, str(tmp_path / "status"), fold=2)
    each = refresh.refresher(lambda b: b, lambda c: published.append(c.count()), status)
    for rows, epoch in ((0, 0), (2, 1), (2, 1), (3, 2), (0, 3), (1, 4)):
        each(spark.range(rows), epoch)
    again = refresh.Status(spark, str(tmp_path / "status"), fold=2)
    assert published == [2, 3, 1] and again.read() == {"epoch": 4, "published": 3, "suppressed": 2, "changes": 6}
    failing = refresh.refresher(lambda b: b, lambda c: 1 / 0, again)
    with pytest.raises(ZeroDivisionError):
        failing(spark.range(1), 5)
    assert again.read()["error"].startswith("ZeroDivisionError")
    refresh.refresher(lambda b: b, lambda c: None, again)(spark.range(1), 5)
    assert "error" not in again.read() and again.read()["published"] == 4


def test_observed_metrics_are_recorded(spark, tmp_path):
    rows = [("k", BASE, BASE, 3, ["a", "b"], False, 0), ("k", BASE, BASE, 9, [], True, 1)]
    spark.createDataFrame(rows, refresh.OUTPUT).coalesce(1).write.parquet(str(tmp_path / "in"))
    status = refresh.Status(spark, str(tmp_path / "metrics"))
    watcher = refresh.Watcher(status)
    spark.streams.addListener(watcher)
    try:
        stream = refresh.observed(spark.readStream.schema(refresh.OUTPUT).parquet(str(tmp_path / "in")))
        drain(stream.withColumn("paths", F.size("paths")), tmp_path / "c", "o", [])
        for _ in range(50):
            if "events" in status.read():
                break
            __import__("time").sleep(0.2)
    finally:
        spark.streams.removeListener(watcher)
    assert {k: status.read()[k] for k in ("batches", "events", "paths", "rescans", "overflows")} == {"batches": 2, "events": 12, "paths": 2, "rescans": 1, "overflows": 1}
