"""Removal of repeated passages by suffix sorting: multikey quicksort to a shallow depth, blind tries below it.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id. Each such string has
an anchor: its 24-byte piece with the smallest hash, so equal strings have equal anchors at equal places. Documents travel in
packed batches. First each batch learns which of its anchors occur more than once in the corpus. Only around those, it sends
the bytes of all strings with that anchor, each distinct segment once with the smallest doc_id that has it, to the anchor's
bucket. There all the suffixes of segments that begin such a string are sorted to `length` bytes, equal ones share the
smallest doc_id, and each segment is told which of its strings are repeats. Last, each batch merges these into spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, ids_array, lean, pack_documents, rows_of, settle, unpacked
from .lookup import bucket_bits, cuts_of, mix, squeezed, swollen, told_totals, totals

LENGTH = 50
PIECE = 24
SHALLOW = 16


def _words(buf: np.ndarray, order: str) -> np.ndarray:
    """The 8 bytes from each place of buf as an integer; buf ends with 8 bytes of padding at least."""
    return np.ndarray((len(buf) - 7,), np.dtype(f"{order}u8"), buf, strides=(1,))


class Anchors:
    """Anchors of all strings of `length` bytes within documents: place, first and last start of their strings, key; in order."""

    def __init__(self, blob: bytes, lengths: np.ndarray, length: int) -> None:
        n = len(blob)
        self.buf = buf = np.frombuffer(blob + bytes(length + 16), np.uint8)
        ends = np.cumsum(lengths)
        self.doc_start = ends - lengths
        word = _words(buf, "<")
        k = max(0, n - PIECE + 1)
        h = word[:k] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += word[8 : k + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(31)
        h += word[16 : k + 16] * np.uint64(0x165667B19E3779F9)
        h = mix(h)
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(k, dtype=np.uint64)
        window, wide = length - PIECE + 1, 1
        while 2 * wide <= window:
            least = np.minimum(least[: max(0, len(least) - wide)], least[wide:])
            wide *= 2
        rest = window - wide
        if rest:
            least = np.minimum(least[: max(0, len(least) - rest)], least[rest:])
        many = np.maximum(0, lengths - length + 1)
        starts = np.repeat(self.doc_start - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)][: len(at)])
        self.first, self.last = starts[new], starts[np.append(new[1:], len(starts)) - 1] if len(new) else starts
        self.key = mix(h[at[new]] ^ np.uint64(0x27D4EB2F165667C5))
        self.doc = np.searchsorted(self.doc_start, self.first, side="right") - 1

    def segments(self, ids: np.ndarray, keep: np.ndarray, length: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct segments of the kept anchors by (key, bytes): bytes, key, smallest doc_id, and each anchor's place, number."""
        at = np.flatnonzero(keep)
        at = at[np.argsort(self.key[at], kind="stable")]
        raw = self.buf.tobytes()
        seen: dict[bytes, int] = {}
        number = np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in zip(self.first[at].tolist(), (self.last[at] + length).tolist(), strict=True)), np.int64, len(at))
        key, least = np.zeros(len(seen), np.uint64), np.full(len(seen), np.iinfo(np.int64).max)
        key[number] = self.key[at]
        np.minimum.at(least, number, ids[self.doc[at]])
        return list(seen), key, least, at, number


def _refined(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, key), and the groups of equal (group, key) in that order; group is in order already."""
    by = np.argsort(key, kind="stable")
    by = by[np.argsort(group[by], kind="stable")]
    g, k = group[by], key[by]
    return by, np.cumsum(np.r_[False, (g[1:] != g[:-1]) | (k[1:] != k[:-1])][: len(g)])


def deep_shallow_sort(buf: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at starts by their first `length` bytes (24 or more), and the class of equal ones, in order.

    Shallow: a quicksort by characters of 8 bytes, one position after the other, within what is equal so far. Deep: each group
    still equal at SHALLOW bytes becomes a blind trie: its members leave the path of its first member at the byte where they
    first differ; those that leave together form the next group. All groups' tries grow side by side.
    """
    word = _words(buf, ">")
    order = np.argsort(word[starts])
    key = word[starts[order]]
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]][: len(key)])
    for at in range(8, SHALLOW, 8):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        by, inner = _refined(group[tied], word[starts[order[tied]] + at].astype(np.uint64))
        order[tied] = order[tied[by]]
        fresh = np.r_[True, group[1:] != group[:-1]][: len(group)]
        fresh[tied] |= np.r_[True, inner[1:] != inner[:-1]][: len(inner)]
        group = np.cumsum(fresh) - 1
    whole = np.zeros(len(group), bool)
    while True:
        size = np.bincount(group)
        open_ = np.flatnonzero((size[group] > 1) & ~whole)
        if not len(open_):
            return order, group
        g = group[open_]
        head = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        lead = starts[order[open_]][np.repeat(head, np.diff(np.append(head, len(g))))]
        mine = starts[order[open_]]
        left = np.full(len(mine), length)
        for at in [*range(SHALLOW, length - 8, 8), length - 8]:
            live = np.flatnonzero(left == length)
            differ = word[mine[live] + at].astype(np.uint64) ^ word[lead[live] + at].astype(np.uint64)
            apart = differ > 0
            # The first byte that differs is the highest in big-endian order.
            byte = np.zeros(int(apart.sum()), np.int64)
            d = differ[apart]
            for step in (32, 16, 8):
                low = d < (np.uint64(1) << np.uint64(64 - step))
                byte += low * (step // 8)
                d = np.where(low, d << np.uint64(step), d)
            left[live[apart]] = at + byte
        off = left < length
        own = np.where(off, buf[mine + np.minimum(left, length - 1)], 0).astype(np.int64)
        theirs = np.where(off, buf[lead + np.minimum(left, length - 1)], 0)
        side = np.where(~off, 1, np.where(own < theirs, 0, 2))
        branch = (side * (length + 1) + np.where(side == 0, left, np.where(side == 2, length - left, 0))) * 256 + own
        by, inner = _refined(g, branch.astype(np.uint64))
        order[open_] = order[open_[by]]
        whole[open_] = ~off[by]
        fresh = np.r_[True, group[1:] != group[:-1]]
        fresh[open_] |= np.r_[True, inner[1:] != inner[:-1]]
        group = np.cumsum(fresh) - 1


def _repeats(parts: list[bytes], least: np.ndarray, length: int) -> np.ndarray:
    """For each segment the bits of its strings that also start in a document with a smaller id."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    buf = np.frombuffer(b"".join(parts) + bytes(length + 16), np.uint8)
    many = size - length + 1
    own = np.repeat(np.arange(len(parts)), many)
    bit = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    starts = np.repeat(np.cumsum(size) - size, many) + bit
    order, group = deep_shallow_sort(buf, starts, length)
    low = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(low, group, least[own[order]])
    repeat = low[group] < least[own[order]]
    out = np.zeros(len(parts), np.uint64)
    np.bitwise_or.at(out, own[order[repeat]], np.uint64(1) << bit[order[repeat]].astype(np.uint64))
    return out


def _repeats_of_all(parts: list[bytes], number: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """_repeats() for segments given by their numbers among the distinct parts, which are sorted once each."""
    low = np.full(len(parts), np.iinfo(np.int64).max)
    np.minimum.at(low, number, least)
    out = _repeats(parts, low, length)[number]
    # All strings of a segment are repeats where the same bytes come with a smaller id.
    out[least > low[number]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, text_too: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed `spans` (start, stop in bytes), one row per input row.

    Null texts are empty. Texts below `length` bytes lose nothing. Rows of the same doc_id do not count as repeats of one
    another; a null doc_id counts as smaller than all others. text_too adds `kept`, what is left as text, without the bytes of
    a character that was cut, and `text_hash`, xxhash64(text) of texts that lost something. Other columns are not read.
    """
    if not PIECE + 8 <= length <= PIECE + 63:
        raise ValueError("length is 32 to 87 bytes")
    packed = settle(pack_documents(docs), "packed")
    bits = bucket_bits(packed)

    def anchors(row: dict) -> tuple[np.ndarray, Anchors]:
        ids, lengths, blob = unpacked(row)
        return ids, Anchors(blob, lengths, length)

    def keys_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(anchors(row)[1].key, return_counts=True)

    def repeated(a: Anchors, told: list[dict] | None) -> np.ndarray:
        _, inverse = np.unique(a.key, return_inverse=True)
        return told_totals(told)[inverse] > 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, a = anchors(row)
            parts, key, least, _, _ = a.segments(ids, repeated(a, row["told"]), length)
            bucket, cut = cuts_of(key, bits)
            spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket, pa.int64()),
                    pa.array(np.full(len(bucket), row["m"]), pa.int64()),
                    pa.array([squeezed(np.frombuffer(b"".join(parts[x:y]), np.uint8)) for x, y in spans], pa.binary()),
                    pa.array([squeezed(np.array([len(p) for p in parts[x:y]], np.uint8)) for x, y in spans], pa.binary()),
                    pa.array([squeezed(least[x:y]) for x, y in spans], pa.binary()),
                ],
                names=["bucket", "m", "parts", "sizes", "least"],
            )

    def compare(t: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        number: list[np.ndarray] = []
        least: list[np.ndarray] = []
        for blob, sizes, low in zip(*(t.column(c).to_pylist() for c in ("parts", "sizes", "least")), strict=True):
            raw, ends = swollen(blob, "u1").tobytes(), np.cumsum(swollen(sizes, "u1"), dtype=np.int64).tolist()
            number.append(np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in zip([0, *ends], ends, strict=False)), np.int64, len(ends)))
            least.append(swollen(low, "<i8"))
        told = _repeats_of_all(list(seen), np.concatenate(number), np.concatenate(least), length)
        ends = np.cumsum([len(n) for n in number])
        out = pa.table({"m": t.column("m"), "bucket": t.column("bucket"), "bits": pa.array([squeezed(told[e - len(n) : e]) for n, e in zip(number, ends, strict=True)], pa.binary())})
        del seen, number, least, told
        give_back()
        return out

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for row in rows_of(batches):
            ids, lengths, blob = unpacked(row)
            a = Anchors(blob, lengths, length)
            _, _, least, at, number = a.segments(ids, repeated(a, row["told"]), length)
            told = sorted(row["bits"] or [], key=lambda p: p["bucket"])
            mask = np.concatenate([swollen(p["bits"], "<u8") for p in told]) if told else np.zeros(0, np.uint64)
            late = ids[a.doc[at]] > least[number]
            mask = np.where(late, np.uint64(0xFFFFFFFFFFFFFFFF), mask[number] if len(number) else np.zeros(0, np.uint64))
            change = np.zeros(len(blob) + length + 1, np.int32)
            span = a.last[at] - a.first[at]
            for k in range(int(span.max(initial=-1)) + 1):
                s = a.first[at][(k <= span) & ((mask >> np.uint64(k)) & np.uint64(1) > 0)] + k
                np.add.at(change, s, 1)
                np.add.at(change, s + length, -1)
            gone = np.cumsum(change[: len(blob)]) > 0
            edge = np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8))
            edge_start, edge_stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            # Runs of neighbouring documents may touch; they are cut where a document begins.
            inner = a.doc_start[lengths > 0]
            inner = inner[(inner > 0) & (inner < len(blob))]
            inner = inner[gone[inner] & gone[inner - 1]]
            starts, stops = np.sort(np.concatenate([edge_start, inner])), np.sort(np.concatenate([edge_stop, inner]))
            doc = np.searchsorted(a.doc_start, starts, side="right") - 1
            lo, hi = np.searchsorted(doc, np.arange(len(ids)), side="left"), np.searchsorted(doc, np.arange(len(ids)), side="right")
            out: dict[str, list] = {c: [] for c in ("n_removed", "n_spans", "kept_sha256", "kept", "spans", "text_hash")}
            for d, (begin, size) in enumerate(zip(a.doc_start.tolist(), lengths.tolist(), strict=True)):
                own = [(int(s) - begin, int(e) - begin) for s, e in zip(starts[lo[d] : hi[d]], stops[lo[d] : hi[d]], strict=True)]
                kept, last = [], 0
                for s, e in own:
                    kept.append(blob[begin + last : begin + s])
                    last = e
                kept.append(blob[begin + last : begin + size])
                left = b"".join(kept)
                out["n_removed"].append(size - len(left))
                out["n_spans"].append(len(own))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["kept"].append(left.decode("utf-8", "ignore") if text_too else None)
                out["text_hash"].append(xxh64_intdigest(blob[begin : begin + size], 42) - ((1 << 64) if xxh64_intdigest(blob[begin : begin + size], 42) >> 63 else 0) if text_too and own else None)
                out["spans"].append([{"start": s, "stop": e} for s, e in own])
            yield pa.RecordBatch.from_arrays(
                [
                    ids_array(ids),
                    pa.array(lengths),
                    pa.array(out["n_removed"], pa.int64()),
                    pa.array(out["n_spans"], pa.int64()),
                    pa.array(out["kept_sha256"], pa.string()),
                    pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                    pa.array(out["kept"], pa.string()),
                    pa.array(out["text_hash"], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "text_hash"],
            )

    told = settle(totals(packed, keys_of, bits), "anchor-totals")
    sent = packed.join(told, "m", "left").mapInArrow(lean(send), "bucket long, m long, parts binary, sizes binary, least binary")
    answers = sent.groupBy("bucket").applyInArrow(compare, "m long, bucket long, bits binary")
    answers = settle(answers.groupBy("m").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits")), "repeats")
    spans = packed.join(told, "m", "left").join(answers, "m", "left").mapInArrow(
        lean(finish), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>, kept string, text_hash long"
    )
    return spans if text_too else spans.drop("kept", "text_hash")
