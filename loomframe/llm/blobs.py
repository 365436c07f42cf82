"""Bulk shuffle of numpy arrays: one row per batch and bucket instead of one per item.

A task packs what it found in a few MB of text into one zstd frame per bucket;
after the shuffle a task unpacks the frames of its one bucket.  The number of
buckets follows the bytes of the input (``tables.bucket_count``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays), *(a.dtype.itemsize for a in arrays)], np.uint32)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    head = np.frombuffer(raw, np.uint32, 2 * n, 4)
    out, at = [], 4 + 8 * n
    for count, width in zip(head[:n].tolist(), head[n:].tolist(), strict=True):
        out.append(np.frombuffer(raw, f"u{width}", count, at))
        at += count * width
    return out


SCHEMA = "bucket int, blob binary"


def batch(buckets: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def deal(df: DataFrame, buckets: int) -> DataFrame:
    """One partition per bucket."""
    return df.repartitionById(buckets, F.col("bucket"))


def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The unpacked frames of a partition, one after another."""
    for rb in batches:
        for blob in rb.column("blob"):
            yield unpack(blob.as_buffer())


def by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket of these hashes, and the bucket edges in it."""
    b = ((h >> np.uint64(16)) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)
    order = np.argsort(b.astype(np.uint16 if buckets < 65536 else np.uint32), kind="stable")
    return order, np.searchsorted(b[order], np.arange(buckets + 1))
