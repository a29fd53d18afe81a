"""Change-stream queries over ``events``: users are watched roots, event types are kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import changes as C
from skein.plans.registry import query, table

KIND = {"signup": "create", "purchase": "modify", "error": "remove", "view": "access", "click": "close_write"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KIND.items() for x in kv]), F.col("event_type"))
    n = F.col("event_id")
    path = F.element_at(F.array(F.concat(F.lit("src/f"), n % 40, F.lit(".py")), F.concat(F.lit("notes/t"), n % 9, F.lit(".txt")), F.lit("target/x.rs"), F.concat(F.lit("docs/d"), n % 5), F.lit(".astro/p.md"), F.lit("settings.json"), F.lit(".env"), F.lit("state/x"), F.lit(".hg/y"), F.lit(".astro/made/z"), F.lit("lib/skip")), (n % 11 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id", kind.alias("kind"), path.alias("path"))


EVENTS = "x AS (SELECT user_id AS key, ts, event_id, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KIND.items()) + " END AS kind, CASE event_id % 11 WHEN 0 THEN 'src/f' || event_id % 40 || '.py' WHEN 1 THEN 'notes/t' || event_id % 9 || '.txt' WHEN 2 THEN 'target/x.rs' WHEN 3 THEN 'docs/d' || event_id % 5 WHEN 4 THEN '.astro/p.md' WHEN 5 THEN 'settings.json' WHEN 6 THEN '.env' WHEN 7 THEN 'state/x' WHEN 8 THEN '.hg/y' WHEN 9 THEN '.astro/made/z' ELSE 'lib/skip' END AS path FROM events)"


@query("event_filter", f"WITH {EVENTS} SELECT kind, path, count(*) AS n FROM x WHERE kind <> 'access' AND ((starts_with(path, 'src/') AND NOT regexp_matches(path, '^src/f1.?\\.py$')) OR path = 'settings.json') GROUP BY ALL")
def event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return rows.where(C.relevant(F.col("kind"), F.col("path"), config=["settings.json"], protected=["state"], ignore=["f1?.py", "f1.py"])).groupBy("kind", "path").agg(F.count("*").alias("n"))


@query("directory_rescan", f"WITH {EVENTS} SELECT kind, path, count(*) AS n FROM x WHERE kind = 'remove' AND (starts_with(path, 'docs/') OR path IN ('.env', '.astro/made/z')) GROUP BY ALL")
def directory_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.rescans(F.col("kind"), F.col("path"), config=["settings.json"], protected=["state"], include=[".astro/made/*", "docs/*"], exclude=["lib/"])
    return events(spark, sf_dir).where(folder).groupBy("kind", "path").agg(F.count("*").alias("n"))


@query("debounce_sessions", f"WITH {EVENTS}, g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s FROM x WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)), b AS (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS batch FROM g) SELECT key, CAST(batch AS BIGINT) AS batch, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS last, count(*) AS event_count FROM b GROUP BY key, batch")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return C.sessions(events(spark, sf_dir), 1800).select("key", "batch", micros("started"), micros("last"), "event_count")


CAPPED = f"""{EVENTS}, o AS (SELECT kind AS key, ts, event_id, row_number() OVER (PARTITION BY kind ORDER BY ts, event_id) AS i FROM x),
w AS (SELECT key, i, ts, event_id, ts AS opened, 1 AS batch FROM o WHERE i = 1 UNION ALL
 SELECT o.key, o.i, o.ts, o.event_id, CASE WHEN o.ts >= least(w.ts + INTERVAL 30 MINUTE, w.opened + INTERVAL 2 HOUR) THEN o.ts ELSE w.opened END, CASE WHEN o.ts >= least(w.ts + INTERVAL 30 MINUTE, w.opened + INTERVAL 2 HOUR) THEN w.batch + 1 ELSE w.batch END FROM w JOIN o ON o.key = w.key AND o.i = w.i + 1)"""


@query("debounce_capped", f"WITH RECURSIVE {CAPPED} SELECT key, batch, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS last, count(*) AS event_count FROM w GROUP BY key, batch")
def debounce_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("key", F.col("kind"))
    return C.capped(rows, 1800, 7200).groupBy("key", "batch").agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("started"), F.unix_micros(F.max("ts").cast("timestamp")).alias("last"), F.count("*").alias("event_count"))


@query("overflow_collapse", f"WITH RECURSIVE {CAPPED}, p AS (SELECT DISTINCT w.key, batch, path, max(kind = 'remove' AND (starts_with(path, 'docs/') OR path IN ('.env', 'state/x', 'lib/skip'))) OVER (PARTITION BY w.key, batch) AS rescan FROM w JOIN x USING (event_id)), s AS (SELECT key, batch, count(*) AS n, bool_or(rescan) AS rescan, string_agg(path, ',' ORDER BY path) AS paths FROM p GROUP BY key, batch) SELECT key, batch, CASE WHEN n > 20 OR rescan THEN '' ELSE paths END AS paths, (n > 20 OR rescan) AS full_rescan, CAST(n > 20 AS BIGINT) AS overflow_count FROM s")
def overflow_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("key", F.col("kind")).withColumn("rescan", C.rescans(F.col("kind"), F.col("path")))
    found = C.coalesce_batches(C.capped(rows, 1800, 7200), most_paths=20)
    return found.select("key", "batch", F.array_join("paths", ",").alias("paths"), "full_rescan", "overflow_count")


@query("refresh_status", f"WITH RECURSIVE {CAPPED}, p AS (SELECT w.key, w.batch, count(*) AS events, count(DISTINCT path) AS paths FROM w JOIN x USING (event_id) GROUP BY 1, 2) SELECT key, count(*) AS batches, CAST(sum(events) AS BIGINT) AS events, CAST(sum(CASE WHEN paths > 6 THEN 1 ELSE 0 END) AS BIGINT) AS overflows, CAST(sum(CASE WHEN paths > 6 THEN 0 ELSE paths END) AS BIGINT) AS paths FROM p GROUP BY key")
def refresh_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("key", F.col("kind")).withColumn("rescan", F.lit(False))
    found = C.coalesce_batches(C.capped(rows, 1800, 7200), most_paths=6)
    return found.groupBy("key").agg(F.count("*").alias("batches"), F.sum("event_count").alias("events"), F.sum("overflow_count").alias("overflows"), F.sum(F.size("paths")).alias("paths"))


@query("change_routing", f"WITH {EVENTS} SELECT DISTINCT path, CASE WHEN starts_with(path, 'docs/') THEN 'wiki' WHEN path LIKE '%.rs' OR path LIKE '%.py' THEN 'graph' END AS consumer FROM x WHERE NOT starts_with(path, '.astro') AND (starts_with(path, 'docs/') OR path LIKE '%.rs' OR path LIKE '%.py')")
def change_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.streaming.refresh import route

    return route(events(spark, sf_dir).select("path").distinct(), ["docs"])
