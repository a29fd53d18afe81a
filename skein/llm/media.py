"""Media columns with content-defined chunks.

A payload is stored as 8-bit mono WAV. The stored form is cut where a rolling gear hash of the last 32
bytes ends in zeros, so equal passages of different media give equal chunks. The chunk store keeps each
digest's bytes once (compressed), bucketed by digest; a manifest lists every medium's digests in order.
Reading joins manifest and store on the digest, regroups by medium, and checks the whole medium's digest.

Chunks are stored in waves of their digests, and media read back in waves of theirs: only one wave's bytes
are in flight. The store's side of the reading join isn't shuffled at all.

Defined cases: null text counts as empty and gives one padded block; repeated rows and equal texts share
one manifest and one set of chunks; an empty table gives no rows; extra columns are ignored; a digest that
doesn't match on reading raises an error.
"""

from __future__ import annotations

import atexit
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import free_shuffles, materialize, plan_bytes, slices

BLOCK, FILL = 576, b"\xff"
SMALLEST, LARGEST, MASK = 512, 8192, (1 << 11) - 1
HEADER = 44


def _gears() -> np.ndarray:
    """A fixed random 32-bit number for each byte."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4, person=b"skein-gear").digest(), "little") for b in range(256)], dtype=np.uint32)


GEARS = _gears()


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK, FILL)


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """8-bit unsigned mono PCM."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples


def samples_of(media: bytes) -> bytes:
    (size,) = struct.unpack("<I", media[40:HEADER])
    if media[:4] != b"RIFF" or size != len(media) - HEADER:
        raise ValueError("not a medium of this store")
    return media[HEADER:]


def cuts(media: bytes) -> list[int]:
    """Ends of the chunks."""
    h = GEARS[np.frombuffer(media, dtype=np.uint8)]
    for step in (1, 2, 4, 8, 16):  # sums of doubled reach: 32 bytes in the end
        h[step:] += h[:-step] << np.uint32(step)
    marks = np.flatnonzero((h >> np.uint32(16)) & np.uint32(MASK) == 0) + 1
    ends, start, n = [], 0, len(media)
    while n - start > SMALLEST:
        at = np.searchsorted(marks, start + SMALLEST)
        end = min(int(marks[at]) if at < len(marks) else n, start + LARGEST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    start = 0
    for end in cuts(media):
        data = media[start:end]
        yield hashlib.sha256(data).digest(), data
        start = end


def feature(samples: bytes) -> str:
    """Mean, deviation, histogram entropy and a 64-bit brightness hash of the samples."""
    x = np.frombuffer(samples, dtype=np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    parts = np.add.reduceat(x, np.arange(64) * len(x) // 64, dtype=np.int64) / np.diff(np.append(np.arange(64) * len(x) // 64, len(x)))
    bits = np.packbits(parts > x.mean()).tobytes().hex()
    return f"{x.mean():.6f} {x.std():.6f} {-(p[p > 0] * np.log2(p[p > 0])).sum():.6f} {bits}"


@dataclass
class MediaStore:
    """``manifest``: doc_id, n_bytes, media_sha256, media_bytes, digests, in order; ``chunks``: table of digest and data."""

    manifest: DataFrame
    chunks: str
    waves: int

    def media(self, wave: int | None = None) -> DataFrame:
        """Each distinct medium, put together from its chunks and verified: media_sha256, media."""
        return self._assembled(lambda sha, media: {"media": media}, [("media", pa.binary(), "binary")], wave)

    def features(self) -> DataFrame:
        """Per distinct medium, from the bytes read back: digests, sizes, tail checksum and features."""

        def of(sha: bytes, media: bytes) -> dict:
            samples = samples_of(media)
            return {"payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-32:]), "media_bytes": len(media), "feature": feature(samples)}

        fields = [("payload_bytes", pa.int64(), "bigint"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "bigint"), ("media_bytes", pa.int64(), "bigint"), ("feature", pa.string(), "string")]
        out = None
        for w in range(self.waves):
            part = materialize(self._assembled(of, fields, w), "features")
            free_shuffles(self.manifest.sparkSession)
            out = part if out is None else out.unionByName(part)
        return out

    def _assembled(self, of, fields: list, wave: int | None) -> DataFrame:  # noqa: ANN001
        import zstandard

        spark = self.manifest.sparkSession
        lists = self.manifest.select("media_sha256", "digests")
        if wave is not None:
            lists = lists.where(F.pmod(F.xxhash64("media_sha256"), F.lit(self.waves)) == wave)
        lists = lists.dropDuplicates(["media_sha256"])
        parts = lists.select("media_sha256", F.size("digests").alias("n"), F.posexplode("digests").alias("pos", "digest")).join(spark.table(self.chunks), "digest", "left")
        ordered = parts.select("media_sha256", "n", "pos", "data").repartition("media_sha256").sortWithinPartitions("media_sha256", "pos")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack, open_sha, held = zstandard.ZstdDecompressor().decompress, None, []
            for batch in batches:
                rows: list[dict] = []
                for sha, n, data in zip(*(batch.column(c).to_pylist() for c in ("media_sha256", "n", "data")), strict=True):
                    if sha != open_sha:
                        open_sha, held = sha, []
                    if data is None:
                        raise ValueError(f"the store lacks a chunk of {sha.hex()}")
                    held.append(unpack(data))
                    if len(held) == n:
                        media = b"".join(held)
                        if hashlib.sha256(media).digest() != sha:
                            raise ValueError(f"medium {sha.hex()} reads back differently")
                        rows.append({"media_sha256": sha, **of(sha, media)})
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in [("media_sha256", pa.binary()), *[f[:2] for f in fields]]], names=["media_sha256", *[f[0] for f in fields]])

        return ordered.mapInArrow(run, ", ".join(["media_sha256 binary", *[f"{name} {kind}" for name, _, kind in fields]]))


#: The plan's bytes to a bucket of chunks, and the fewest buckets.
BUCKET_BYTES, BUCKETS = 256 << 20, 48


def store(docs: DataFrame, buckets: int | None = None, waves: int = 4, known: str | None = None) -> MediaStore:
    """Store the texts of ``docs`` as media. ``known``: a chunk table of before; its digests aren't stored again.

    Buckets follow the plan's own estimate of its bytes, 48 at least.
    """
    import zstandard

    spark = docs.sparkSession
    if buckets is None:
        buckets = max(BUCKETS, plan_bytes(docs) // BUCKET_BYTES)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, shas, lengths, digests = [], [], [], []
            for text in batch.column("text").to_pylist():
                media = wav(payload(text))
                sizes.append(len((text or "").encode()))
                shas.append(hashlib.sha256(media).digest())
                lengths.append(len(media))
                digests.append([d for d, _ in chunks(media)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary()), pa.array(lengths, pa.int64()), pa.array(digests, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "media_sha256", "media_bytes", "digests"])

    def data(batches: Iterator[pa.RecordBatch], wave: int) -> Iterator[pa.RecordBatch]:
        pack, seen = zstandard.ZstdCompressor(level=3).compress, set()  # digests of this task's own rows
        for batch in slices(batches, "text"):
            found: dict[bytes, bytes] = {}
            for text in batch.column("text").to_pylist():
                for digest, part in chunks(wav(payload(text))):
                    if digest[0] % waves == wave and digest not in seen:
                        seen.add(digest)
                        found[digest] = pack(part)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "data"])

    manifest = materialize(texts.mapInArrow(lists, "doc_id bigint, n_bytes bigint, media_sha256 binary, media_bytes bigint, digests array<binary>"), "manifest")
    table = known or f"skein_chunks_{uuid.uuid4().hex}"
    if not known:
        atexit.register(_drop, spark, table)
    for w in range(waves):  # each wave's shuffle goes before the next one's; cutting again costs little
        fresh = texts.select("text").mapInArrow(partial(data, wave=w), "digest binary, data binary")
        if known:
            fresh = fresh.join(spark.table(known).select("digest"), "digest", "left_anti")
        fresh = fresh.repartition(buckets, "digest").dropDuplicates(["digest"])
        fresh.write.option("compression", "uncompressed").mode("append").bucketBy(buckets, "digest").saveAsTable(table, format="parquet")
        del fresh
        free_shuffles(spark)
    return MediaStore(manifest, table, waves)


def _drop(spark, table: str) -> None:  # noqa: ANN001
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # noqa: BLE001  the session is gone; so is its catalog
        return
