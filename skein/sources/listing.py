"""A stream of file changes found by comparing listings, for file systems that send no events.

``spark.dataSource.register(Listing)``, then ``spark.readStream.format("listing")`` with the options ``path`` (what to
watch), ``state`` (a folder that driver and executors share) and, if wanted, ``shards``, gives rows (path, change,
mtime, byte_len, seen_at): change is created, changed or deleted. Both folders may be of any file system that
Arrow opens by its address.

An offset is the number of a listing. Whenever a trigger finds the files other than in the last listing, the new one is
stored under the next number, in shards by path, and counts once its mark is there. A batch compares two stored
listings, a task a shard, so it can be replayed: a stream that restarts from its checkpoint goes on from the listing
it had come to, and neither loses what changed meanwhile nor repeats what it has told. Listings before the last
finished batch are deleted. A new stream begins with the files as they are.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, change string, mtime bigint, byte_len bigint, seen_at timestamp"


class Shard(InputPartition):
    def __init__(self, start: int, end: int, shard: int):
        self.start, self.end, self.shard = start, end, shard


def opened(address: str):  # noqa: ANN201
    """The file system of an address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)


class Listings:
    """Numbered listings under a folder: ``n/shard`` holds lines of [path, mtime, length], ``n/done`` when it was taken."""

    def __init__(self, state: str, shards: int):
        self.fs, self.root = opened(state.rstrip("/"))
        self.shards = shards

    def numbers(self) -> list[int]:
        """Of complete listings, in order."""
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        names = [int(f.base_name) for f in found if f.type == fs.FileType.Directory and f.base_name.isdigit()]
        return sorted(n for n in names if self.fs.get_file_info(f"{self.root}/{n}/done").type == fs.FileType.File)

    def read(self, n: int, shard: int) -> dict[str, tuple[int, int]]:
        with self.fs.open_input_stream(f"{self.root}/{n}/{shard}") as f:
            return {path: (mtime, size) for path, mtime, size in map(json.loads, f.read().splitlines())}

    def seen_at(self, n: int) -> int:
        with self.fs.open_input_stream(f"{self.root}/{n}/done") as f:
            return json.loads(f.read())["at"]

    def digest(self, n: int) -> str:
        with self.fs.open_input_stream(f"{self.root}/{n}/done") as f:
            return json.loads(f.read())["digest"]

    def write(self, n: int, shards: list[list[str]], digest: str) -> None:
        self.fs.create_dir(f"{self.root}/{n}", recursive=True)
        for k, lines in enumerate([*shards, [json.dumps({"at": int(time.time() * 1_000_000), "digest": digest})]]):
            with self.fs.open_output_stream(f"{self.root}/{n}/{k if k < len(shards) else 'done'}") as f:
                f.write("\n".join(lines).encode())

    def forget(self, before: int) -> None:
        for n in self.numbers():
            if n < before:
                self.fs.delete_dir(f"{self.root}/{n}")


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.watched, self.shards = options["path"].rstrip("/"), int(options.get("shards", 16))
        self.listings = Listings(options["state"], self.shards)

    def _take(self) -> tuple[list[list[str]], str]:
        """The files as they are, in shards of sorted lines, and a digest of all."""
        from pyarrow import fs

        system, root = opened(self.watched)
        shards: list[list[str]] = [[] for _ in range(self.shards)]
        for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if f.type == fs.FileType.File:
                path = f.path[len(root) :].lstrip("/")
                shards[zlib.crc32(path.encode()) % self.shards].append(json.dumps([path, f.mtime_ns or 0, f.size]))
        digest = 0
        for lines in shards:
            lines.sort()
            digest = zlib.crc32("\n".join(lines).encode(), digest)
        return shards, f"{digest:08x}-{sum(map(len, shards))}"

    def _store(self) -> int:
        numbers, (shards, digest) = self.listings.numbers(), self._take()
        if numbers and self.listings.digest(numbers[-1]) == digest:
            return numbers[-1]
        n = numbers[-1] + 1 if numbers else 0
        self.listings.write(n, shards, digest)
        return n

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"listing": self._store()}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"listing": self._store()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [] if start == end else [Shard(start["listing"], end["listing"], k) for k in range(self.shards)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        before, now = self.listings.read(partition.start, partition.shard), self.listings.read(partition.end, partition.shard)
        rows = [(p, "created" if p not in before else "changed", *v) for p, v in now.items() if before.get(p) != v] + [(p, "deleted", *v) for p, v in before.items() if p not in now]
        if rows:
            path, change, mtime, size = zip(*sorted(rows), strict=True)
            at = pa.array([self.listings.seen_at(partition.end)] * len(rows), pa.timestamp("us", "UTC"))
            columns = [pa.array(path, pa.string()), pa.array(change, pa.string()), pa.array([t // 1000 for t in mtime], pa.int64()), pa.array(size, pa.int64()), at]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "change", "mtime", "byte_len", "seen_at"])

    def commit(self, end: dict) -> None:
        self.listings.forget(end["listing"])


class Listing(DataSource):
    """``spark.readStream.format("listing")``."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return Reader(self.options)
