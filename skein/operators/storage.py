"""Files of any Hadoop file system, and tables written aside to cut a plan's lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


class Files:
    """A folder's small files, by names relative to it. ``create`` fails where the name exists: the one step that
    decides between writers."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str = "") -> bool:
        """Write a new file; False if there is one."""
        path = self._path(name)
        self.fs.mkdirs(path.getParent())
        try:
            stream = self.fs.create(path, False)
        except Exception:  # noqa: BLE001  file systems raise errors of their own
            if self.fs.exists(path):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def replace(self, name: str, text: str) -> None:
        """Write a file beside ``name``, then rename it over that in one step."""
        aside = f"{name.rpartition('/')[0]}/.{name.rpartition('/')[2]}.{uuid.uuid4().hex}".lstrip("/")
        self.create(aside, text)
        hadoop = self.jvm.org.apache.hadoop.fs
        over = getattr(hadoop, "Options$Rename")
        options = SparkSession.getActiveSession().sparkContext._gateway.new_array(over, 1)
        options[0] = over.OVERWRITE
        path = self.fs.makeQualified(self._path(name))
        hadoop.FileContext.getFileContext(path.toUri(), self.fs.getConf()).rename(self.fs.makeQualified(self._path(aside)), path, options)

    def sizes(self, folder: str) -> dict[str, int]:
        """Bytes of each part of a folder, as stored."""
        return {n: self.fs.getContentSummary(self._path(f"{folder}/{n}")).getLength() for n in self.names(folder)}

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder)) if not s.getPath().getName().startswith("."))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is empty (a local session) a temporary folder stands in."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark.sparkContext, "_skein_tables", None)
        if folder is None:
            folder = spark.sparkContext._skein_tables = "file://" + tempfile.mkdtemp(prefix="skein-")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/skein-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later plans start there, and a lost executor costs a read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_digest(*tables: DataFrame) -> str:
    """What tells these stored tables from any other state of them: their files' paths, lengths and times."""
    out = []
    for rows in tables:
        found = rows.select(*(F.col("_metadata")[c].alias(c) for c in ("file_path", "file_size", "file_modification_time"))).distinct()  # reads footers only
        out += found.agg(F.count("*"), F.sum(F.xxhash64(*found.columns).cast("decimal(38,0)"))).first()
    return " ".join(map(str, out))


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            Files(spark, path).delete("")
        except Exception:  # noqa: BLE001  the session may be gone; the folder is then the cluster's to clear
            return
