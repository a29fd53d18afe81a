"""Staged rows in numbered JSON files: ``stem.json``, ``stem__000001.json`` and so on, each an array."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from skein.operators.storage import Files


def chunk_names(names: list[str], stem: str) -> list[str]:
    """A stem's files in order; a gap in their numbers is an error."""
    found = {0: f"{stem}.json"} if f"{stem}.json" in names else {}
    for name in names:
        match = re.fullmatch(re.escape(stem) + r"__(\d{6})\.json", name)
        if match:
            found[int(match[1])] = name
    if found and sorted(found) != list(range(len(found))):
        raise ValueError(f"{stem} lacks chunk {next(n for n in range(len(found)) if n not in found)}")
    return [found[n] for n in sorted(found)]


def read_chunks(spark: SparkSession, folder: str, stem: str, schema: str) -> DataFrame:
    """The rows of all chunks of ``stem``; no file gives no rows, a damaged one an error."""
    names = chunk_names(Files(spark, folder).names(""), stem)
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json([f"{folder.rstrip('/')}/{n}" for n in names])
