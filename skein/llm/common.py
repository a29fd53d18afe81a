"""Shared helpers: the cluster's shared folder, Arrow batch slicing, bounded samples."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``.

    Only where that setting is empty (a local session, as in tests) a temporary folder stands in.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark.sparkContext, "_skein_folder", None)
        if folder is None:
            folder = "file://" + tempfile.mkdtemp(prefix="skein-")
            spark.sparkContext._skein_folder = folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/skein-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is then the cluster's to clear
            return


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again.

    A lost executor then costs a read, not the work behind it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """What the plan itself takes its bytes to be; 0 where it doesn't know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that nobody holds any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice's texts hold about ``most`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(sizes):
            if i > start and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def unique_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names near ``wanted`` that no column of ``df`` has, letter case aside."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % divisor


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int, max_bytes: int, cut: bool = False, most_bytes: int = 192 << 20) -> tuple[list[tuple], dict]:
    """Texts of up to ``per_label`` labelled ids of each label, and each label's count among all ids.

    Counts by label give each label's share of the hash range; only ids within that share are sorted, and
    those with the smallest hashes (then ids) are kept. Their texts come by a join with that bounded list.
    Texts over ``max_bytes`` are left out, or with ``cut`` give their first ``max_bytes // 4`` characters. Every label
    is sampled, in a job of its own. Returns (doc_id, text, label).

    An id counts once: of labels that repeat for it the least, of its texts the least. ``most_bytes`` bounds
    what the driver holds: where texts as long as allowed could exceed it, fewer ids of each label are taken.
    """
    ids = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).alias("label")).where("label is not null and doc_id is not null")
    counts = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").collect()}
    hashed = ids.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    picked: dict[int, object] = {}
    for value, n in counts.items():
        share = min(1 << 20, int((1 << 20) * (per_label * 1.3 + 60) / n) + 1)
        rows = hashed.where((F.col("label") == F.lit(value)) & (F.col("h") < share)).distinct().orderBy("h", "doc_id").limit(per_label).collect()
        for r in rows:
            picked[r["doc_id"]] = min(value, picked.get(r["doc_id"], value))
    if not picked:
        return [], counts
    spark = docs.sparkSession
    listed = spark.createDataFrame([(i, str(rank)) for rank, i in enumerate(sorted(picked, key=lambda i: hashlib.blake2b(b"%d" % i).digest()))], "wanted bigint, rank string")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    short = F.octet_length("text") <= max_bytes
    texts = texts.withColumn("text", F.when(short, F.col("text")).otherwise(F.substring("text", 1, max_bytes // 4))).where("text is not null") if cut else texts.where(short)
    found = texts.join(F.broadcast(listed), F.col("doc_id") == F.col("wanted")).groupBy("doc_id", F.col("rank").cast("int").alias("rank")).agg(F.min("text").alias("text"))
    rows, held_bytes = [], 0
    for r in found.orderBy("rank").toLocalIterator():
        held_bytes += len(r["text"]) * 2  # what a text of two-byte letters takes
        if held_bytes > most_bytes and rows:
            break
        rows.append((r["doc_id"], r["text"], picked[r["doc_id"]]))
    return sorted(rows, key=lambda x: x[0]), counts


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000) -> Iterator[None]:
    """Let jobs inside send at most so many rows at a time to Python: rows with whole texts are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def held(kind: str, key: object, make):  # noqa: ANN001, ANN201
    """What ``make`` returns, kept for later tasks of the same Python worker; one object of each kind."""
    import sys

    kept = sys.__dict__.setdefault("_skein_held", {})
    if kept.get(kind, (None,))[0] != key:
        kept[kind] = (key, make())
    return kept[kind][1]


def by_value(spark: SparkSession, model: object):  # noqa: ANN201
    """A function that gives ``model`` in any task: broadcast with its classes, so that workers need no copy of this package.

    A worker keeps one model of each class, the last one used.
    """
    from pyspark import cloudpickle

    shared, key, kind = spark.sparkContext.broadcast(cloudpickle.dumps(model)), uuid.uuid4().hex, type(model).__module__

    def get():  # noqa: ANN202
        return held(kind, key, lambda: cloudpickle.loads(shared.value))

    return get


def give_back() -> None:
    """Return what Arrow and the C library keep of freed memory to the system, where the library can."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
