"""Training-order materialisation: fixed-stride binary shards in a keyed random order.

Every document's token ids (with an end id) are cut into sequences of ``stride`` ids, the last one padded.
Sequences are numbered by the place of their row in the stored table (file, row in it) and their piece, so
numbers are the same however a cluster splits the files. A keyed Feistel permutation with cycle-walking gives each number its slot: slot and number determine each
other, so order needs no sort key and no random state. Slots are dealt by range to shards of ``per_shard``
records; a record is the ids as little-endian unsigned 16-bit numbers and one line feed, so slot s starts
at byte (s mod per_shard) * (2 * stride + 1) of shard s div per_shard. A reader needs only the slot it
stopped at.

Shards are written in waves of slot ranges, a task and a file to a shard, by Spark's file writer (any file
system, atomic commits): only one wave's shuffle exists at a time. ``resume`` skips waves that are complete,
once the folder's record of its order (count, key, stride, records a shard, vocabulary, digest of all numbered
sequences) proves equal; another order raises an error.

Defined cases: null and empty texts give one sequence that holds the end id; repeated rows give sequences
of their own; rows that aren't read straight from files are numbered by their partition, then in its order;
an empty table writes nothing and gives no rows; extra columns are ignored; ids must be below 65,536.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import drop_path, free_shuffles, give_back, held, materialize, new_path, slices, small_batches
from skein.llm.words import WordIds

ROUNDS = 6


def _round_keys(key: str) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest(), "little") for r in range(ROUNDS)]


def permute(numbers: np.ndarray, n: int, key: str, inverse: bool = False) -> np.ndarray:
    """A permutation of 0 to n-1: a balanced Feistel network on an even number of bits, walked back into range."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(k) for k in _round_keys(key)]

    def mixed(x: np.ndarray, k: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x + k) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(32)
            x = x * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) & mask

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ mixed(left, k), left
            else:
                left, right = right, left ^ mixed(right, k)
        return left << shift | right

    out = once(numbers.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


@dataclass
class Store:
    """``index``: a row per sequence (doc_id, piece, n_ids, number, slot); ``path``: the folder of shards."""

    index: DataFrame
    path: str
    n: int
    stride: int
    per_shard: int

    @property
    def record(self) -> int:
        return 2 * self.stride + 1

    def read(self, spark: SparkSession) -> DataFrame:
        """The shards as written, cut into records: slot and ids (little-endian unsigned 16-bit)."""
        return self._records(spark, bytes, pa.binary(), "ids binary")

    def checksums(self, spark: SparkSession) -> DataFrame:
        """slot and crc32 of its ids, from the shards as written."""
        return self._records(spark, zlib.crc32, pa.int64(), "ids_crc32 bigint")

    def _records(self, spark: SparkSession, of, kind: pa.DataType, column: str) -> DataFrame:  # noqa: ANN001
        files = spark.read.format("binaryFile").load(f"{self.path}/wave=*/part-*.txt")
        record, size, per_shard, total, name = self.record, 2 * self.stride, self.per_shard, self.n, column.split()[0]

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                    data = memoryview(content.as_buffer())
                    n = len(data) // record
                    if len(data) != min(per_shard, total - shard * per_shard) * record:
                        raise ValueError(f"shard {shard} has {len(data)} bytes")
                    values = [of(data[i * record : i * record + size]) for i in range(n)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + shard * per_shard, pa.int64()), pa.array(values, kind)], names=["slot", name])

        first, part = (F.regexp_extract("path", x, 1).cast("bigint") for x in (r"wave=(\d+)/", r"/part-(\d+)-"))
        return files.where("length > 0").select((first + part).alias("shard"), "content").mapInArrow(cut, f"slot bigint, {column}")


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id and text with where each row is stored: file (name, then path) and row in it; null where that is unknown."""
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")]
    try:
        at = docs.metadataColumn("_metadata")
        file = F.concat_ws("\n", at["file_name"], at["file_path"])
        out = docs.select(*columns, file.alias("file"), at["row_index"].alias("row"))
        out.schema  # noqa: B018  analysed here
        return out
    except AnalysisException:  # not a scan of files
        return docs.select(*columns, F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("row"))


def token_sequences(docs: DataFrame, tokenizer_path: str, stride: int, end_id: int) -> DataFrame:
    """A row per sequence: doc_id, piece, n_ids, ids, their crc32, and its place: run of rows of one file, and at which place in it.

    The first sequence of a run holds the run's file and first row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = held("words", (tokenizer_path, 2), lambda: WordIds(tokenizer_path, 2)), np.array([end_id], dtype="<u2").tobytes()
        part, step = TaskContext.get().partitionId(), 2 * stride
        own_run, at, open_file, next_row = -1, 0, None, None
        for batch in slices(batches, "text"):
            give_back()
            out: list[list] = [[] for _ in range(9)]
            texts = encoder.encode(batch.column("text").to_pylist())
            for doc_id, file, row, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "file", "row")), texts, strict=True):
                if own_run < 0 or file != open_file or file is not None and row != next_row:
                    own_run, at, open_file = own_run + 1, 0, file
                next_row = row + 1 if row is not None else None
                own += end
                for k in range(0, len(own), step):
                    cut = own[k : k + step]
                    data = cut.ljust(step, b"\0")
                    first = at == 0
                    for column, value in zip(out, (doc_id, k // step, len(cut) // 2, data, zlib.crc32(data), own_run, at, (file or "") if first else None, (row or 0) if first else None), strict=True):
                        column.append(value)
                    at += 1
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(out[0]), part), pa.int64())], names=["doc_id", "piece", "n_ids", "ids", "crc", "run", "at", "file", "row", "part"])

    return _placed(docs).mapInArrow(run, "doc_id bigint, piece int, n_ids int, ids binary, crc bigint, run int, at bigint, file string, row bigint, part bigint")


def build(docs: DataFrame, tokenizer_path: str, key: str, stride: int = 512, end_id: int = 1, per_shard: int = 4_096, waves: int = 4, path: str | None = None, resume: bool = False, most_shards: int = 1_000_000) -> Store:
    """Tokenize, number, permute, and write the shards under ``path`` (by default in the shared folder).

    A shard has ``per_shard`` records, or more where there would be over ``most_shards`` shards.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        made = materialize(token_sequences(docs, tokenizer_path, stride, end_id), "sequences")
    runs = made.groupBy("part", "run").agg(F.count("*").alias("n"), F.max("file").alias("file"), F.max("row").alias("row"))
    before = materialize(_offsets(runs), "offsets")
    numbers = made.join(before, ["part", "run"]).withColumn("number", F.col("before") + F.col("at"))
    n, digest = numbers.agg(F.count("*"), F.sum(F.xxhash64("number", "doc_id", "piece", "n_ids", "crc").cast("decimal(38,0)"))).first()
    path = path or new_path(spark, "shards")
    per_shard = max(per_shard, -(-n // most_shards))

    @F.pandas_udf("bigint")
    def slot(number):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(permute(number.to_numpy(np.int64), n, key))

    numbered = numbers.withColumn("slot", slot("number"))
    shards = -(-n // per_shard)
    waves = min(waves, shards)
    order = {"n": n, "key": hashlib.sha256(key.encode()).hexdigest(), "stride": stride, "end_id": end_id, "per_shard": per_shard, "waves": waves, "vocabulary": _digest(tokenizer_path), "digest": str(digest)}
    _same_order(spark, path, json.dumps(order, sort_keys=True), resume)
    for w in range(waves):
        low, high = shards * w // waves, shards * (w + 1) // waves
        target = f"{path}/wave={low}"  # a wave is named by its first shard
        if resume and _exists(spark, f"{target}/_SUCCESS"):
            continue
        part = numbered.where((F.col("slot") >= low * per_shard) & (F.col("slot") < high * per_shard))
        ordered = _by_shard(part.select("slot", F.col("ids").cast("string").alias("value")), low, high, per_shard)
        ordered.select("value").write.mode("overwrite").text(target, lineSep="\n")
        del part, ordered
        free_shuffles(spark)
    return Store(numbered.select("doc_id", "piece", "n_ids", "number", "slot"), path, n, stride, per_shard)


def _offsets(runs: DataFrame) -> DataFrame:
    """part, run and how many sequences stand before it. Runs are summed within their file (without one, within their
    partition), so that only a table of files is ever in one task: a filter may leave as many runs as rows."""
    runs = runs.withColumn("group", F.when(F.col("file") == "", F.format_string("%012d", F.col("part"))).otherwise(F.concat(F.lit("f"), "file")))
    groups = runs.groupBy("group").agg(F.sum("n").alias("all"))
    groups = groups.select(F.col("group"), (F.sum("all").over(Window.orderBy("group")) - F.col("all")).alias("above"))
    within = F.sum("n").over(Window.partitionBy("group").orderBy("row", "part", "run")) - F.col("n")
    return runs.withColumn("within", within).join(groups, "group").select("part", "run", (F.col("above") + F.col("within")).alias("before"))


def _by_shard(rows: DataFrame, low: int, high: int, per_shard: int) -> DataFrame:
    """Partition i holds shard ``low + i``, in the order of slots."""
    shard: Column = F.floor(F.col("slot") / per_shard) - low
    return rows.repartitionById(high - low, shard.cast("int")).sortWithinPartitions("slot")


def _digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _same_order(spark: SparkSession, path: str, order: str, resume: bool) -> None:
    """Keep the record of the order beside the shards; on resume it must be the one that is there."""
    record = f"{path}/order"
    if resume and _exists(spark, f"{record}/_SUCCESS"):
        if spark.read.text(record).first()[0] != order:
            raise ValueError(f"{path} holds shards of another order")
        return
    if _exists(spark, record):
        drop_path(spark, path)  # a build that isn't to be resumed
    elif _exists(spark, path):
        raise ValueError(f"{path} is no folder of shards")
    spark.createDataFrame([(order,)], "value string").coalesce(1).write.text(record)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
