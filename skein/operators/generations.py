"""Generations: immutable folders of tables, and which of them is current.

Everything is a file under the root, on any Hadoop file system, and what decides between writers is the creation of
a file that must not exist yet. A ticket is such a file and gives a sequence number. A generation is written aside,
validated, and becomes current when the file of its sequence number is created; the highest number is current, and a
writer with a ticket older than another's is refused. Readers hold a generation by a lease file, whichever ``Store``
object made it, so that collecting leaves it alone; a lease that isn't renewed in time holds nothing any more, so a
reader that has died doesn't keep its generation for ever.

Of tables that are to be verified, each file's length and SHA-256 is stored with the generation.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.storage import Files

TICKETS, ACTIVE, LEASES, CHECKSUMS = "tickets", "active", "leases", "checksums"
#: Seconds that a lease holds unless it is renewed.
LEASE = 3600.0


class StaleGeneration(RuntimeError):
    """Another writer has published since this one began."""


@dataclass
class Store:
    root: str
    keep: int = 2
    clock: Callable[[], float] = time.time

    @property
    def files(self) -> Files:
        return Files(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), self.root)

    def current(self) -> dict | None:
        files = self.files
        names = files.names(ACTIVE)
        return json.loads(files.read(f"{ACTIVE}/{names[-1]}")) if names else None

    def next_sequence(self) -> int:
        """A ticket for a new generation, larger than all before."""
        files, n = self.files, self._issued() + 1
        while not files.create(f"{TICKETS}/{n:012d}"):
            n += 1
        return n

    def publish(self, tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], sequence: int | None = None, digest: str | None = None, validate: Callable[[dict[str, DataFrame]], None] | None = None, partition_by: dict[str, str] | None = None, header: dict | None = None, verified: tuple[str, ...] = ()) -> dict:
        """Write ``tables``, check them, and make them current. Equal digests publish nothing (a cache hit).

        A table may be a function of those written before it, so that one derived from another reads it from its files.
        ``header`` is kept with the generation: what its tables hold for. ``damage`` checks the ``verified`` tables.
        """
        now = self.current()
        if digest is not None and now and now["digest"] == digest:
            return now | {"cache": "hit"}
        sequence = self.next_sequence() if sequence is None else sequence
        self._refuse_stale(sequence)
        files, name = self.files, f"gen-{sequence:012d}-{uuid.uuid4().hex[:8]}"
        written: dict[str, DataFrame] = {}
        try:
            for table, made in tables.items():
                df = made(written) if callable(made) else made
                writer, path = df.write, f"{self.root}/{name}/{table}"
                if partition_by and table in partition_by:
                    writer = writer.partitionBy(partition_by[table])
                writer.parquet(path)
                written[table] = df.sparkSession.read.schema(df.schema).parquet(path)
            if verified:
                spark = next(iter(written.values())).sparkSession
                self._stored_files(spark, name, verified).write.parquet(f"{self.root}/{name}/{CHECKSUMS}")
            if validate is not None:
                validate(written)
            self._refuse_stale(sequence)
            entry = {"generation": name, "sequence": sequence, "digest": digest, "published_at": f"unix:{int(time.time() * 1000)}", "header": header, "verified": list(verified)}
            if not files.create(f"{ACTIVE}/{sequence:012d}.json", json.dumps(entry)):
                raise StaleGeneration(f"sequence {sequence} has been published")
        except BaseException:
            files.delete(name)
            raise
        self.collect()
        return entry | {"cache": "miss"}

    def _issued(self) -> int:
        names = self.files.names(TICKETS)
        return int(names[-1]) if names else 0

    def _refuse_stale(self, sequence: int) -> None:
        if sequence < self._issued():
            raise StaleGeneration(f"sequence {sequence} is older than {self._issued()}")

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        entry = self.current()
        if entry is None:
            raise FileNotFoundError("nothing has been published")
        return spark.read.parquet(f"{self.root}/{entry['generation']}/{table}")

    def sizes(self) -> dict[str, int]:
        """Bytes of the current generation's tables, as stored."""
        return self.files.sizes(self.current()["generation"])

    def _stored_files(self, spark: SparkSession, generation: str, tables: tuple[str, ...]) -> DataFrame:
        """(file, byte_len, sha256) of the tables' files as they are stored now."""
        there = [t for t in tables if self.files.exists(f"{generation}/{t}")]
        if not there:
            return spark.createDataFrame([], "file string, byte_len bigint, sha256 string")
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load([f"{self.root}/{generation}/{t}" for t in there])
        return found.select(F.element_at(F.split("path", f"/{generation}/"), -1).alias("file"), F.col("length").alias("byte_len"), F.sha2("content", 256).alias("sha256"))

    def damage(self, spark: SparkSession) -> DataFrame:
        """(file, problem) of the current generation's verified tables: missing, changed or unexpected files."""
        entry = self.current()
        if not entry or not entry.get("verified"):
            return spark.createDataFrame([], "file string, problem string")
        now = self._stored_files(spark, entry["generation"], tuple(entry["verified"])).withColumnsRenamed({"byte_len": "now_len", "sha256": "now"})
        was = spark.read.parquet(f"{self.root}/{entry['generation']}/{CHECKSUMS}")
        same = F.col("now").eqNullSafe(F.col("sha256")) & F.col("now_len").eqNullSafe(F.col("byte_len"))
        return was.join(now, "file", "full").where(~same).select("file", F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").otherwise("changed").alias("problem"))

    def lease(self, seconds: float = LEASE) -> str:
        """Hold the current generation for so long; returns what ``renew`` and ``release`` take."""
        held = f"{self.current()['generation']}/{uuid.uuid4().hex}"
        self.files.create(f"{LEASES}/{held}", self._until(seconds))
        return held

    def _until(self, seconds: float) -> str:
        return str(int((self.clock() + seconds) * 1000))

    def renew(self, held: str, seconds: float = LEASE) -> bool:
        """Hold it longer; False if the generation is gone."""
        files = self.files
        if not files.exists(held.split("/")[0]):
            return False
        files.replace(f"{LEASES}/{held}", self._until(seconds))
        return True

    def release(self, held: str) -> None:
        files = self.files
        files.delete(f"{LEASES}/{held}")
        generation = held.split("/")[0]
        if not files.names(f"{LEASES}/{generation}"):
            files.delete(f"{LEASES}/{generation}")

    def _leased(self) -> set[str]:
        """Generations with a lease in force; expired leases are deleted."""
        files, out, now = self.files, set(), self.clock() * 1000
        for generation in files.names(LEASES):
            for name in files.names(f"{LEASES}/{generation}"):
                until = files.read(f"{LEASES}/{generation}/{name}")
                if not until or int(until) > now:  # an empty one is being written
                    out.add(generation)
                else:
                    self.release(f"{generation}/{name}")
        return out

    def collect(self) -> list[str]:
        """Delete all but the newest ``keep`` generations, the current and the leased ones; and the marks of those gone."""
        files, now = self.files, self.current()
        names = [n for n in files.names("") if n.startswith("gen-")]
        leased = self._leased()
        gone = [n for n in names[: -self.keep] if n not in leased and n != now["generation"]]
        for n in gone:
            files.delete(n)
        for mark in files.names(ACTIVE)[:-1]:
            if json.loads(files.read(f"{ACTIVE}/{mark}"))["generation"] in gone:
                files.delete(f"{ACTIVE}/{mark}")
        return gone


def check_bundle(tables: dict[str, DataFrame]) -> None:
    """A graph's generation: ids are unique, every edge's ends exist, and an index agrees with itself."""
    from skein.operators.graph import missing_endpoints
    from skein.operators.search import PARTS, Index

    nodes, edges = tables["nodes"], tables["edges"]
    for name, df in (("node", nodes), ("edge", edges)):
        twice = df.groupBy("id").count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{name} {twice[0]['id']} stands twice")
    lost = missing_endpoints(nodes, edges).limit(1).collect()
    if lost:
        raise ValueError(lost[0]["message"])
    if all(p in tables for p in PARTS):
        wrong = Index(*(tables[p] for p in PARTS)).problems().limit(1).collect()
        if wrong:
            raise ValueError(f"the index's {wrong[0]['part']} is wrong at {wrong[0]['key']}")


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows in any order."""
    h = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("s")).first()
    return f"{h['n']}-{h['s']}"
