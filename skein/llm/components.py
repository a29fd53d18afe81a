"""Connected components by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import drop_path, new_path


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Large star: a node's greater neighbours move to its least neighbour; small star: the
    node and its lesser neighbours do."""
    if large:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        moved = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("low"))
        moved = down.join(least, "a").where("b <> low").select("b", "low").toDF("a", "b").union(least.toDF("a", "b"))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """From links (a, b) of longs: every linked node with the least node it can reach, as (node, root).

    Each round ends in a written table; the next one starts from that file, so the lineage stays short and
    a lost executor costs one read. The fixed point is when a round changes no link.
    """
    spark = edges.sparkSession
    now, path, seen = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), None, None
    for _ in range(rounds):
        if path is not None:
            now = _stars(_stars(now, True), False)
        new = new_path(spark, "stars")
        now.write.option("compression", "zstd").parquet(new)
        if path is not None:
            drop_path(spark, path)
        path, now = new, spark.read.schema("a bigint, b bigint").parquet(new)
        stamp = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if stamp == seen or not stamp[0]:
            break
        seen = stamp
    else:
        raise RuntimeError(f"the components have not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
