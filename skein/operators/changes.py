"""Change batches: filtering of file events, debouncing with a cap, coalescing and overflow."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import matches_any, plain_pattern
from skein.operators import ordered
from skein.operators.storage import materialize
from skein.sources.scan import is_excluded, language

#: Kinds of events that can change a graph (fixed values).
KINDS = ("create", "modify", "remove", "rename", "any", "other", "close_write")
#: Folders of generated files, a tool's own ones to be added; an include pattern must name them.
GENERATED = (".astro",)
MOST_PATHS, MOST_BYTES = 4096, 1 << 20


def _inside(path: Column, roots: list[str]) -> Column:
    out = F.lit(False)
    for root in roots:
        out = out | (path == root) | path.startswith(root + "/")
    return out


def relevant(kind: Column, path: Column, config: list[str] = (), protected: list[str] = (), include: list[str] = (), ignore: list[str] = (), exclude: list[str] = (), generated: tuple[str, ...] = GENERATED) -> Column:
    """Whether an event refreshes the graph: configuration files always, protected folders never, generated
    ones only if included, then patterns and the suffix decide."""
    included = matches_any(path, list(include)) if include else F.lit(False)
    made = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(g) for g in generated]))
    dropped = (~included if include else F.lit(False)) | matches_any(path, [*ignore, *exclude])
    source = ~_inside(path, protected) & (path != "") & ~is_excluded(path) & (~made | included) & ~dropped & language(path).isNotNull()
    return kind.isin(*KINDS) & (path.isin(*config) | source if config else source)


def rescans(kind: Column, path: Column, config: list[str] = (), protected: list[str] = (), include: list[str] = (), ignore: list[str] = (), exclude: list[str] = (), generated: tuple[str, ...] = GENERATED) -> Column:
    """Whether a removed or renamed path may have been a folder of sources, so that a full scan is due.

    A name without a suffix may be one; a dot at its start begins no suffix. Configuration files, protected, excluded
    and ignored paths aren't. Below a generated folder, the path or something under that folder must be included.
    """
    included = matches_any(path, list(include)) if include else F.lit(False)
    unmade = F.lit(True)
    for g in generated:
        folder = F.regexp_extract(path, rf"^((?:[^/]+/)*?{re.escape(g)})(?:/|$)", 1)
        below = F.lit(False)
        for pattern in include:
            below = below | F.lit(plain_pattern(pattern)).startswith(F.concat(folder, F.lit("/")))
        unmade = unmade & ((folder == "") | included | below)
    bare = F.substring_index(path, "/", -1).rlike(r"^\.?[^.]*$")
    source = ~_inside(path, protected) & (path != "") & ~is_excluded(path) & unmade & ~matches_any(path, [*ignore, *exclude])
    return kind.isin("remove", "rename") & bare & (source & ~path.isin(*config) if config else source)


def _with_gaps(events: DataFrame, gap_seconds: float, key: str) -> DataFrame:
    """Events in order of (key, ts, event_id) with ``at``, and ``quiet``: 1 where a key begins or nothing came for the gap."""
    rows = ordered.placed(events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))), [key, "at", "event_id"], "events")
    rows = ordered.before(rows, F.struct(F.col(key).alias("key"), "at"), "last_")
    same = F.col("last_")["key"].eqNullSafe(F.col(key)) & F.col("last_").isNotNull()
    quiet = ~same | (F.col("at") - F.col("last_")["at"] >= F.lit(int(gap_seconds * 1_000_000)))
    return rows.withColumn("quiet", F.when(quiet, 1).otherwise(0)).drop("last_")


def sessions(events: DataFrame, gap_seconds: float, key: str = "key") -> DataFrame:
    """Debounce without a cap: a batch ends once nothing came for ``gap_seconds``. A busy key spreads over partitions."""
    rows = ordered.running_sum(_with_gaps(events, gap_seconds, key), F.col("quiet"), "batch", key)
    return rows.groupBy(key, "batch").agg(F.min("ts").alias("started"), F.max("ts").alias("last"), F.count("*").alias("event_count"))


def capped(events: DataFrame, debounce_seconds: float, max_wait_seconds: float, key: str = "key") -> DataFrame:
    """Adds batch (from 1) to events (key, ts, event_id, ...): a batch opened at t0 takes what comes before
    min(last + debounce, t0 + max_wait).

    Where the cap cuts a long busy stretch depends on where its predecessor was cut, so this looks like a walk. But which
    event opens the next batch is a function of the event that opened this one: the first one ``max_wait`` later, if no
    quiet gap comes before it. These links are found for all events at once, each quiet gap starts a chain, and
    doubling the links finds all events on the chains. No key, and no stretch, is ever in one task.
    """
    wait = int(max_wait_seconds * 1_000_000)
    rows = ordered.position(_with_gaps(events, debounce_seconds, key), "pos")
    rows = ordered.latest(rows, F.when(F.col("quiet") == 1, F.col("pos")), "stretch")
    rows = materialize(rows, "stretches")
    # stretches shorter than the cap have no cut; stored, as are the openings, so that few are known to be few and no event is shuffled to meet them
    long = rows.groupBy("stretch").agg(F.min("at").alias("from_"), F.max("at").alias("to_")).where(F.col("to_") - F.col("from_") >= wait).select("stretch")
    long = materialize(long, "long")
    inside = materialize(rows.select("stretch", "at", "pos").join(long, "stretch", "left_semi"), "busy")
    opening = rows.where("quiet = 1").select(F.col("pos").alias("at"))
    if not inside.isEmpty():
        here = inside.select("stretch", "at", F.lit(1).alias("kind"), "pos")
        asked = inside.select("stretch", (F.col("at") + wait).alias("at"), F.lit(0).alias("kind"), "pos")
        both = ordered.placed(here.unionByName(asked), ["stretch", "at", "kind", "pos"], "links")
        both = ordered.following(both, F.when(F.col("kind") == 1, F.struct("stretch", "pos")), "next_")
        links = both.where((F.col("kind") == 0) & (F.col("next_")["stretch"] == F.col("stretch"))).select(F.col("pos").alias("at"), F.col("next_")["pos"].alias("to"))
        starts = inside.where("pos = stretch").select(F.col("pos").alias("at"))
        opening = opening.unionByName(ordered.reached(starts, links, "openings")).distinct()
    opening = materialize(opening.select(F.col("at").alias("pos"), F.lit(1).alias("opens")), "opening")
    opened = rows.join(opening, "pos", "left").withColumn("opens", F.coalesce("opens", F.lit(0)))
    out = ordered.running_sum(materialize(opened, "opened"), F.col("opens"), "batch", key)
    return out.select(*events.columns, F.col("batch").cast("int").alias("batch"))


def coalesce_batches(batched: DataFrame, key: str = "key", most_paths: int = MOST_PATHS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Per batch its distinct paths; more paths or bytes than allowed, or a folder that went, make it a full
    rescan without paths. Distinct paths are counted before any is gathered, so a list never exceeds the cap."""
    distinct = batched.groupBy(key, "batch", "path").agg(F.count("*").alias("n"), F.max("rescan").alias("rescan"), F.min("ts").alias("ts"))
    sized = distinct.groupBy(key, "batch").agg(F.sum("n").alias("event_count"), F.count("*").alias("n_paths"), F.sum(F.octet_length("path")).alias("n_bytes"), F.max("rescan").alias("rescan"), F.min("ts").alias("started"))
    sized = sized.withColumn("overflow_count", ((F.col("n_paths") > most_paths) | (F.col("n_bytes") > most_bytes)).cast("bigint")).withColumn("full_rescan", (F.col("overflow_count") > 0) | F.col("rescan"))
    kept = distinct.join(sized.where("not full_rescan").select(key, "batch"), [key, "batch"], "left_semi").groupBy(key, "batch").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    out = sized.join(kept, [key, "batch"], "left")
    return out.select(key, "batch", "started", "event_count", F.coalesce("paths", F.array().cast("array<string>")).alias("paths"), "full_rescan", "overflow_count")
