"""Counting 64-bit keys of packed batches over the whole corpus, and telling each batch the totals of its own keys.

A batch sends each of its distinct keys once, with its count, to the key's bucket (the key's top bits), as one packed row per
bucket. The bucket adds up and answers each batch in the order it was asked, so a batch gets its totals back as a few rows.
The number of buckets follows the bytes of text, so a bucket stays of one size; on the way a key keeps 48 bits besides those
of its bucket, which takes two keys for one in a few of 10^9 cases, at any size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BUCKET_BYTES, lean, rows_of


def bucket_bits(packed: DataFrame) -> int:
    """log2 of the number of buckets for this packed table."""
    size = packed.agg(F.sum("n_bytes")).first()[0] or 0
    return max(6, int(-(-size // BUCKET_BYTES) - 1).bit_length())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads its bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def squeezed(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def swollen(b: bytes, dtype: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype) if b else np.zeros(0, dtype)


def cuts_of(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted keys fall into, and where each begins, with the end."""
    bucket = keys >> np.uint64(64 - bits)
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(keys)])
    return bucket[cut].astype(np.int64), np.append(cut, len(keys))


def _wired(keys: np.ndarray, bits: int) -> bytes:
    """Sorted keys of one bucket as steps from each to the next, in as many bytes as the longest step takes; that number comes first."""
    steps = np.diff((keys << np.uint64(bits)) >> np.uint64(16), prepend=np.uint64(0))
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unwired(b: bytes) -> np.ndarray:
    width = b[0]
    out = np.zeros(((len(b) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def totals(packed: DataFrame, keys_of: Callable[[dict], tuple[np.ndarray, np.ndarray]], bits: int) -> DataFrame:
    """m, told: for each batch its keys' totals over all batches, in parts by bucket, see told_totals().

    keys_of gives the sorted distinct uint64 keys of a packed row, and the count of each.
    """

    def ask(batches):
        for row in rows_of(batches):
            keys, counts = keys_of(row)
            bucket, cut = cuts_of(keys, bits)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket, pa.int64()),
                    pa.array(np.full(len(bucket), row["m"]), pa.int64()),
                    pa.array([_wired(keys[a:b], bits) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    pa.array([squeezed(counts[a:b].astype("<u4")) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                ],
                names=["bucket", "m", "keys", "counts"],
            )

    def answer(t: pa.Table) -> pa.Table:
        parts = [_unwired(b) for b in t.column("keys").to_pylist()]
        counts = np.concatenate([swollen(b, "<u4") for b in t.column("counts").to_pylist()]).astype(np.int64)
        _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(inverse, counts).astype("<i8")[inverse]
        ends = np.cumsum([len(p) for p in parts])
        return pa.table({"m": t.column("m"), "bucket": t.column("bucket"), "total": pa.array([squeezed(total[e - len(p) : e]) for p, e in zip(parts, ends, strict=True)], pa.binary())})

    asked = packed.mapInArrow(lean(ask), "bucket long, m long, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "m long, bucket long, total binary")
    return answers.groupBy("m").agg(F.collect_list(F.struct("bucket", "total")).alias("told"))


def told_totals(told: list[dict] | None) -> np.ndarray:
    """Totals in the order of the batch's sorted keys."""
    parts = [swollen(p["total"], "<i8") for p in sorted(told or [], key=lambda p: p["bucket"])]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)
