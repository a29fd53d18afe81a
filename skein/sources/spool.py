"""A spool of stable contents: what a build parses is what its scan has hashed, whatever happens to the files meanwhile."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTEMPTS = 3
#: Paths that one job is told by name, and beyond which the whole source is read instead.
BLOCK, MOST_LISTED = 5_000, 100_000
SCHEMA = "path string, language string, content_hash string, content binary"


class UnstableSource(RuntimeError):
    """Files that kept changing while they were copied."""


def listed(spark: SparkSession, wanted: DataFrame) -> Iterator[DataFrame]:
    """(absolute_path, content) of named files, in blocks of BLOCK: a few changed files of many are read alone."""
    block: list[str] = []
    escaped = lambda path: re.sub(r"([\\*?\[\]{}])", r"\\\1", path)  # noqa: E731  a name is no pattern

    def read(paths: list[str]) -> DataFrame:
        return spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(paths).select(F.col("path").alias("absolute_path"), "content")

    for row in wanted.select("absolute_path").toLocalIterator():
        block.append(escaped(row["absolute_path"]))
        if len(block) == BLOCK:
            yield read(block)
            block = []
    if block:
        yield read(block)


def spool(spark: SparkSession, wanted: DataFrame, folder: str, whole: Callable[[], DataFrame], prefer_whole: bool = False, attempts: int = ATTEMPTS, before_check: Callable[[int], None] = lambda attempt: None) -> DataFrame:
    """Copy the files of ``wanted`` (path, absolute_path, language, content_hash) to ``folder``: (path, language, content_hash, content).

    A copy counts if what was stored has the hash of the scan, and the source still has it after that; others are copied
    again, up to ``attempts`` times, then ``UnstableSource`` names some of them. ``whole`` reads every file
    (path, content), for builds that want most of them or very many. Contents go from file to file in one task, without a shuffle.
    """
    columns, pending = ["path", "language", "content_hash"], wanted.select("path", "absolute_path", "language", "content_hash")
    good: DataFrame | None = None
    for attempt in range(attempts):
        n, target = pending.count(), f"{folder}/attempt={attempt}"
        if not n:
            break
        by_name = n <= MOST_LISTED and not (prefer_whole and attempt == 0)
        if by_name:
            for k, block in enumerate(listed(spark, pending)):
                block.join(F.broadcast(pending), "absolute_path").select(*columns, "content").write.parquet(f"{target}/block={k}")  # n is at most MOST_LISTED
        else:
            whole().join(pending.select(*columns), "path").select(*columns, "content").write.parquet(f"{target}/block=0")
        before_check(attempt)
        stored = spark.read.schema(SCHEMA).parquet(*[f"{target}/block={k}" for k in range(-(-n // BLOCK) if by_name else 1)])
        copies = stored.where(F.sha2("content", 256) == F.col("content_hash")).select("path")
        if by_name:
            now = None
            for block in listed(spark, pending):
                hashes = block.select("absolute_path", F.sha2("content", 256).alias("now"))
                now = hashes if now is None else now.unionByName(hashes)
            still = pending.join(now, "absolute_path").where("now = content_hash").select("path")
        else:
            still = whole().select("path", F.sha2("content", 256).alias("now")).join(pending, "path").where("now = content_hash").select("path")
        kept = copies.join(still, "path", "left_semi")
        kept.write.parquet(f"{folder}/stable={attempt}")
        kept = spark.read.schema("path string").parquet(f"{folder}/stable={attempt}")
        left = pending.join(kept, "path", "left_anti")
        part = stored if left.isEmpty() else stored.join(kept, "path", "left_semi")
        good, pending = part if good is None else good.unionByName(part), left
    changing = [r["path"] for r in pending.select("path").orderBy("path").limit(10).collect()]
    if changing:
        raise UnstableSource(f"still changing after {attempts} copies: {', '.join(changing)}")
    return good if good is not None else spark.createDataFrame([], SCHEMA)
