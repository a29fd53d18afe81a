"""Sharding by extendible hashing, in DataFrame operations only.

A row's place is the first bits of its key's hash. The directory is found from sums: byte counts of the
buckets at a fine depth are rolled up to every coarser depth, and a bucket stands at the first depth at
which it fits the limit: only buckets that don't fit have been split on another bit. Leaves that are still
too large go through another round at a greater depth, alone. The directory is as large as the number of
shards, never as the number of rows, and rows meet it by a join on their leaf: a broadcast while it has at most
BROADCAST_LEAVES leaves, a shuffle beyond.

Defined cases: null sizes count as 0; a row larger than the limit ends alone in its bucket; rows of one key
that together exceed the limit (no bit tells them apart) are paged by running size; null keys hash as the
text ``null``; an empty table gives no rows; columns of the input that clash with the added ones keep
their names, as the added ones are looked up under fresh names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import materialize, unique_names

#: Bits of the key's hash that can be used.
BITS = 60
#: Leaves up to which the directory is broadcast (some 40 bytes each).
BROADCAST_LEAVES = 1 << 18
#: Depth of a round beyond what even buckets would need.
SPARE = 4


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the md5 of the key's text."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _leaf(h: Column, depth: int) -> Column:
    return F.shiftright(h, BITS - depth)


def _resolve(rows: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """Leaves at depth ``high`` as (leaf, depth, bytes, rows) of the bucket that holds each; depth null: too large."""
    leaves = rows.groupBy(_leaf(F.col("h"), high).alias("leaf")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    leaves = materialize(leaves, "leaves")
    every = leaves.select("leaf", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "bytes", "n")
    every = every.withColumn("prefix", F.expr(f"shiftright(leaf, {high} - depth)"))
    sums = every.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("rows"))
    fits = sums.where((F.col("bytes") <= limit) | (F.col("rows") == 1))
    found = every.select("leaf", "depth", "prefix").join(fits.hint("merge"), ["depth", "prefix"])
    first = found.groupBy("leaf").agg(F.min_by(F.struct("depth", "bytes", "rows"), "depth").alias("b"))
    return leaves.select("leaf").join(first.hint("merge"), "leaf", "left").select("leaf", "b.depth", "b.bytes", "b.rows")


def assign(df: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """Per row of ``df``: key, size, depth, prefix, page (0 but for rows that share a hash), and the shard's bytes and rows."""
    rows = materialize(df.select(F.col(key).alias("key"), hash_bits(F.col(key)).alias("h"), F.coalesce(size.cast("bigint"), F.lit(0)).alias("size")), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total) / limit))) + SPARE)
    low, out, rest = 0, [], rows
    while True:
        directory = materialize(_resolve(rest, limit, low, depth), "directory")
        small = directory.count() <= BROADCAST_LEAVES  # else rows and directory meet by a shuffle
        placed = rest.withColumn("leaf", _leaf(F.col("h"), depth)).join(F.broadcast(directory) if small else directory.hint("merge"), "leaf")
        out.append(placed.where("depth is not null").select("key", "h", "size", "depth", F.lit("0").alias("page"), "bytes", "rows"))
        if directory.where("depth is null").isEmpty():
            break
        rest = materialize(placed.where("depth is null").select("key", "h", "size"), "crowded")
        if depth == BITS:
            out.append(_pages(rest, limit))
            break
        low, depth = depth + 1, min(BITS, depth + 8)
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.select("key", "size", "depth", F.expr(f"shiftright(h, {BITS} - depth)").alias("prefix"), "page", "bytes", "rows")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows whose hashes are equal, dealt to pages of at most ``limit`` bytes (a larger row alone).

    The running size is taken within a hash and an input partition of the stored rows, so a key that holds
    a third of all rows is paged in as many tasks as it fills.
    """
    rows = rows.withColumn("part", F.spark_partition_id()).withColumn("large", F.col("size") > limit / 2).withColumn("at", F.monotonically_increasing_id())
    own = Window.partitionBy("h", "part", "large")
    before = F.sum("size").over(own.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    most = F.max("size").over(own)
    page = F.when(F.col("large"), F.col("at")).otherwise(F.floor(F.coalesce(before, F.lit(0)) / (F.lit(limit) - most + 1)))
    rows = rows.withColumn("page", F.concat_ws("-", F.col("part"), F.col("large").cast("int"), page))
    sums = rows.groupBy("h", "page").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return rows.join(sums, ["h", "page"]).select("key", "h", "size", F.lit(BITS).alias("depth"), "page", "bytes", "rows")


def write_shards(df: DataFrame, key: str, size: Column, limit: int, path: str) -> DataFrame:
    """Write ``df`` as Parquet, a folder per shard; returns the assignment. Keys must be unique (null is one key)."""
    shard, own = unique_names(df, "shard", "shard_key")
    placed = materialize(assign(df, key, size, limit), "assigned")
    name = F.concat_ws("-", F.col("depth"), F.lpad(F.conv(F.col("prefix").cast("string"), 10, 16), 15, "0"), F.col("page")).alias(shard)
    if placed.groupBy("key").count().where("count > 1").isEmpty():
        rows = df.join(placed.select(F.col("key").alias(own), name), F.col(key).eqNullSafe(F.col(own))).drop(own)
        rows.repartition(shard).write.partitionBy(shard).parquet(path)
        return placed
    raise ValueError(f"{key} repeats: its rows cannot be told apart when they are written")
