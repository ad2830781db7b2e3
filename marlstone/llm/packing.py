"""Sum-of-squares packing of token pieces into sequences of a fixed length.

Documents longer than a sequence are cut into whole sequences and a rest. The pieces below a sequence's length are dealt by a
hash into groups of bounded, even size; each group packs its pieces, longest first: among the open bins a piece fits in, it
goes where the sum over gaps of the squared number of open bins with that gap becomes smallest, and it opens a bin where none
fits. The last step empties the bins that stayed loosest into one another, best fit first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, settle
from .tokens import slices_by_size, tokenizer, with_end

#: Pieces a packing group has on average; the groups' loss is a few loose bins each.
GROUP = 8192


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the documents' ids, each with end_id behind them, cut at capacity.

    A null or empty text is the end id alone. Repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = tokenizer(path)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            for at in slices_by_size(texts):
                ids, counts = with_end(*cut(texts[at]), end_id)
                pieces = -(-counts // capacity)
                own = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, counts[own] - start)
                first = (np.cumsum(counts) - counts)[own] + start
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [names.slice(at.start, at.stop - at.start).take(pa.array(own)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run, tokens=True), "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to capacity)."""
    order = np.argsort(-lengths, kind="stable")
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    gaps: list[int] = []
    bins = np.empty(len(lengths), np.int64)
    for k in order.tolist():
        s = int(lengths[k])
        if s == capacity:
            bins[k] = len(gaps)
            gaps.append(0)
            continue
        # From gap h to h - s: the sum of squares changes by 2 (count[h - s] - count[h]) + 2, or by 1 - 2 count[h] if nothing is left.
        change = 2 * (count[: capacity + 1 - s] - count[s:]) + 2
        change[0] = 1 - 2 * count[s]
        change[count[s:] == 0] = np.iinfo(np.int64).max
        left = int(change.argmin())
        if count[left + s]:
            b = open_bins[left + s].pop()
            count[left + s] -= 1
        else:
            b, left = len(gaps), capacity - s
            gaps.append(capacity)
        gaps[b] = left
        bins[k] = b
        if left:
            open_bins[left].append(b)
            count[left] += 1
    bins = _tightened(lengths, bins, np.array(gaps, np.int64), capacity)
    by_bin = np.lexsort((np.arange(len(bins)), bins))
    run = np.cumsum(lengths[by_bin]) - lengths[by_bin]
    new = np.r_[True, bins[by_bin][1:] != bins[by_bin][:-1]][: len(bins)]
    offset = np.empty(len(bins), np.int64)
    offset[by_bin] = run - run[np.flatnonzero(new)][np.cumsum(new) - 1] if len(bins) else run
    return bins, offset


def _tightened(lengths: np.ndarray, bins: np.ndarray, gaps: np.ndarray, capacity: int) -> np.ndarray:
    """Bins after the loosest were emptied into the others' gaps, best fit first, wherever all of their pieces fit."""
    members: dict[int, list[int]] = {}
    for b in np.argsort(-gaps, kind="stable"):
        if gaps[b] < capacity // 8:
            break
        members[int(b)] = []
    for k, b in enumerate(bins.tolist()):
        if b in members:
            members[b].append(k)
    gaps = gaps.copy()
    for b, own in members.items():
        moved: list[tuple[int, int]] = []
        held, gaps[b] = gaps[b], -1
        for k in sorted(own, key=lambda k: -lengths[k]):
            fits = np.where(gaps >= lengths[k], gaps, capacity + 1)
            to = int(fits.argmin())
            if fits[to] > capacity:
                break
            gaps[to] -= lengths[k]
            moved.append((k, to))
        if len(moved) < len(own):
            for k, to in moved:
                gaps[to] += lengths[k]
            gaps[b] = held
        else:
            for k, to in moved:
                bins[k] = to
                if to in members:
                    members[to].append(k)
    return bins


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece; an empty table gives no rows.

    Null texts are packed as the end id alone; rows with a null doc_id are packed too and keep it. Ties in length go by
    arrival. Other columns are not read.
    """
    pieces = settle(token_pieces(docs, path, capacity, end_id), "pieces")
    groups = max(1, round(pieces.count() / group))

    def run(t: pa.Table) -> pa.Table:
        bins, offset = sum_of_squares(t.column("length").to_numpy(), capacity)
        base = t.column("g")[0].as_py() << 32
        return t.drop_columns("g").append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offset))

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
