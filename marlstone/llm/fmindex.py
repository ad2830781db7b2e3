"""Benchmark decontamination by an FM-index over each shard of training documents.

A shard is a run of documents of a partition, as words. Words outside the benchmark cannot be part of a match, so they and the
documents' ends become separators, each its own symbol. The suffixes of the shard are sorted by tripling of ranks, their
Burrows-Wheeler transform is kept as a wavelet tree, level by level, with ranks, and all windows of the benchmark are searched
backwards at once. Occurrences are located by walking back to a sampled suffix position; their spans are merged per document.
No shuffle is needed; one shard after the other is in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, encoded, lean, settle

#: Words of a shard, one document at least. Longer documents are sharded with an overlap of a window less a word.
SHARD = 1 << 20
#: Distance of sampled suffix positions.
SAMPLE = 8
#: Bytes of benchmark text whose windows are sent to all tasks at once; a larger benchmark goes in several passes.
BLOCK_BYTES = 4 << 20
#: Words are what is left between ASCII characters other than letters and digits; A-Z count as a-z.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return encoded(text).translate(_WORDS).split()


class Windows:
    """Distinct windows of benchmark items as arrays of word numbers (from 1), by length, and the items that have each."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = 13) -> None:
        self.word: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            nums = [self.word.setdefault(w, len(self.word) + 1) for w in words_of(text)]
            for k in range(max(1, len(nums) - width + 1) if nums else 0):
                found.setdefault(tuple(nums[k : k + width]), set()).add(name)
        self.owners = [sorted(x) for x in found.values()]
        self.by_length: list[tuple[np.ndarray, np.ndarray]] = []
        every = list(found)
        for n in sorted({len(w) for w in every}):
            rows = [k for k, w in enumerate(every) if len(w) == n]
            self.by_length.append((np.array(rows), np.array([every[k] for k in rows], np.int64)))


class FMIndex:
    """Over symbols 0 (separator) and up. Matches never hold a separator."""

    def __init__(self, x: np.ndarray) -> None:
        x = np.append(x, 0)
        self.n = n = len(x)
        suffix = _suffix_array(x)
        self.last = last = x[suffix - 1]
        self.top = int(x.max())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(x))])
        # Of the suffix positions only the sampled ones are kept, and how many of them are up to each row.
        self.sampled = (suffix % SAMPLE == 0) | (last == 0)
        self.sample, self.samples = suffix[self.sampled].astype(np.int32), np.cumsum(self.sampled, dtype=np.int32)
        self.levels: list[np.ndarray] = []
        rest, self.height = last, max(1, self.top.bit_length())
        for level in range(self.height - 1, -1, -1):
            bit = (rest >> level & 1).astype(bool)
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            rest = np.concatenate([rest[~bit], rest[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first `at` entries of the transform."""
        base = np.zeros(len(at), np.int64)
        for ones, level in zip(self.levels, range(self.height - 1, -1, -1), strict=True):
            up = (symbol >> level & 1).astype(bool)
            zeros = self.n - ones[-1]
            a, b = ones[at], ones[base]
            at, base = np.where(up, zeros + a, at - a), np.where(up, zeros + b, base - b)
        return at - base

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each pattern (one per row, of equal length), searched from its end."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            known = c <= self.top
            c = np.where(known, c, 0)
            a, b = self.first[c] + self.rank(c, lo[live]), self.first[c] + self.rank(c, hi[live])
            lo[live], hi[live] = a, np.where(known, b, a)
            live = live[hi[live] > lo[live]]
        gone = np.ones(len(patterns), bool)
        gone[live] = False
        hi[gone] = lo[gone]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps back to the next sampled position."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walk = np.flatnonzero(~self.sampled[rows])
        while len(walk):
            c = self.last[rows[walk]]
            rows[walk] = self.first[c] + self.rank(c, rows[walk])
            steps[walk] += 1
            walk = walk[~self.sampled[rows[walk]]]
        return self.sample[self.samples[rows] - 1] + steps


def _suffix_array(x: np.ndarray) -> np.ndarray:
    """Suffixes in order, where every 0 is a symbol of its own (earlier ones smaller) below all others."""
    n = len(x)
    zero = x == 0
    rank = np.where(zero, np.cumsum(zero) - 1, int(zero.sum()) + x.astype(np.int64) - 1)
    shift = np.int64(max(1, int(max(n, rank.max(initial=0) + 1)).bit_length()))
    order, todo, depth = np.arange(n), np.arange(n), 1
    first = True
    while len(todo):
        at = np.zeros(0, np.int64)
        parts = [rank[todo]]
        for h in (depth, 2 * depth):
            at = todo + h
            parts.append(np.where(at < n, rank[np.minimum(at, n - 1)] + 1, 0))
        if 3 * shift <= 63:
            key = (parts[0] << (2 * shift)) | (parts[1] << shift) | parts[2]
            by = np.argsort(key)
            new = np.r_[True, key[by][1:] != key[by][:-1]]
        else:
            by = np.lexsort(parts[::-1])
            new = np.r_[True, np.any([p[by][1:] != p[by][:-1] for p in parts], axis=0)]
        todo = todo[by]
        group = np.flatnonzero(new)[np.cumsum(new) - 1]
        if first:
            rank, first = np.empty(n, np.int64), False
            place = np.arange(n)
            rank[todo] = group
        else:
            base = rank[todo]
            start = np.r_[True, base[1:] != base[:-1]]
            head = np.flatnonzero(start)[np.cumsum(start) - 1]
            place = base + np.arange(len(todo)) - head
            rank[todo] = base + group - head
        order[place] = todo
        size = np.diff(np.r_[np.flatnonzero(new), len(todo)])
        todo = todo[np.repeat(size > 1, size)]
        depth *= 3
    return order


def _search_shard(windows: Windows, docs: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """Merged spans of hit words, and items with occurring windows, for each document (as words)."""
    counts = np.array([len(d) for d in docs], np.int64)
    begin = np.cumsum(counts) - counts
    num = np.fromiter(map(windows.word.get, (w for d in docs for w in d), repeat(0)), np.int64, int(counts.sum()))
    cut = np.zeros(len(num), bool)
    cut[begin[counts > 0]] = True
    # A run of separators is one; a document's first word gets one before it.
    own = num > 0
    keep = own | np.r_[True, own[:-1]][: len(num)]
    at = np.flatnonzero(keep)
    x, place = num[at], at
    lead = np.flatnonzero(cut[at] & (x > 0))
    x, place = np.insert(x, lead, 0), np.insert(place, lead, -1)
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    items: list[set[str]] = [set() for _ in docs]
    if not own.any():
        return spans, items
    index = FMIndex(x)
    cover = np.zeros(len(num) + 1, np.int64)
    for rows, patterns in windows.by_length:
        lo, hi = index.search(patterns)
        many = hi - lo
        hit = np.flatnonzero(many)
        if not len(hit):
            continue
        who = np.repeat(hit, many[hit])
        row = np.repeat(lo[hit] - (np.cumsum(many[hit]) - many[hit]), many[hit]) + np.arange(len(who))
        start = place[index.locate(row)]
        np.add.at(cover, start, 1)
        np.add.at(cover, start + patterns.shape[1], -1)
        doc = np.searchsorted(begin, start, side="right") - 1
        for d, w in np.unique(np.stack([doc, rows[who]]), axis=1).T.tolist():
            items[d].update(windows.owners[w])
    covered = np.cumsum(cover[:-1]) > 0
    edge = np.diff(np.r_[False, covered, False].astype(np.int8))
    # A run ends at its document's end.
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        while s < e:
            d = int(np.searchsorted(begin, s, side="right") - 1)
            stop = min(e, int(begin[d] + counts[d]))
            spans[d].append((s - int(begin[d]), stop - int(begin[d])))
            s = stop
    return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_STATE = "doc_id long, text string, n_words long, spans array<struct<start:int,stop:int>>, items array<string>"


def _marked(docs: DataFrame, shared: Broadcast[Windows], width: int, text_too: bool, keep: tuple[str, ...]) -> DataFrame:
    """docs (doc_id, text, spans, items and the columns to keep) with the occurrences of one block's windows added."""
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple], kept: list[pa.RecordBatch]) -> pa.RecordBatch:
            parts: list[list[bytes]] = []
            origin: list[tuple[int, int]] = []
            for r, (_, _, words, _, _) in enumerate(rows):
                for k in range(0, max(1, len(words) - width + 1), SHARD):
                    parts.append(words[k : k + SHARD + width - 1])
                    origin.append((r, k))
            spans, items = [list(r[3]) for r in rows], [set(r[4]) for r in rows]
            groups, size = [[]], 0
            for j, p in enumerate(parts):
                if size and size + len(p) > SHARD:
                    groups.append([])
                    size = 0
                groups[-1].append(j)
                size += len(p)
            for g in groups:
                for j, own, names in zip(g, *_search_shard(shared.value, [parts[j] for j in g]), strict=True):
                    r, k = origin[j]
                    spans[r] += [(s + k, e + k) for s, e in own]
                    items[r] |= names
            also = pa.Table.from_batches(kept).combine_chunks()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] if text_too else None for r in rows], pa.string()),
                    pa.array([len(r[2]) for r in rows], pa.int64()),
                    pa.array([[{"start": s, "stop": e} for s, e in _merged(x)] for x in spans], span_type),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    *(also.column(c).chunk(0) for c in keep),
                ],
                names=["doc_id", "text", "n_words", "spans", "items", *keep],
            )

        rows, size, kept = [], 0, []
        for batch in batches:
            others, begun = batch.select([batch.schema.get_field_index("doc_id"), *(batch.schema.get_field_index(c) for c in keep)]), 0
            for at, (i, text, spans, items) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "spans", "items")), strict=True)):
                words = words_of(text)
                if rows and size + len(words) > SHARD:
                    yield done(rows, [*kept, others.slice(begun, at - begun)])
                    rows, size, kept, begun = [], 0, [], at
                rows.append((i, text, words, [(s["start"], s["stop"]) for s in spans], items))
                size += len(words)
            kept.append(others.slice(begun))
        if rows:
            yield done(rows, kept)

    kinds = dict(docs.dtypes)
    return docs.select("doc_id", "text", "spans", "items", *keep).mapInArrow(lean(run), ", ".join([_STATE, *(f"{c} {kinds[c]}" for c in keep)]))


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's items in blocks of about block_bytes of text; the driver has one block at a time."""
    block: list[tuple[str, str | None]] = []
    size = 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text").cast("string")).toLocalIterator():
        n = len(r[1] or "")
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (of hit words), row for row, and the columns of docs to keep.

    Null texts have no words and nothing hits them. An item without words has no window; an item with a null id is named
    "null", repeated ids count once. An empty benchmark hits nothing. Other columns of either table are not read. Each block of
    a benchmark beyond block_bytes is a pass over the documents, whose state so far is a table in the shared folder.
    """
    also, context = tuple(c for c in keep if c not in ("doc_id", "text")), docs.sparkSession.sparkContext
    empty = [F.expr("cast(array() as array<struct<start:int,stop:int>>) as spans"), F.expr("cast(array() as array<string>) as items")]
    state = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *empty, *also)
    before: DataFrame | None = None
    blocks = _blocks(benchmark, block_bytes)
    items = next(blocks)
    while True:
        more = next(blocks, None)
        shared = context.broadcast(Windows(items, width))
        state = _marked(state, shared, width, more is not None or "text" in keep, also)
        if more is None:
            break
        settled = settle(state, "marked", "zstd")
        shared.destroy()
        if before is not None:
            drop_settled(before)
        before = state = settled
        items = more
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["stop"] - s["start"]))
    return (
        state.withColumn("n_hit", n_hit)
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
        .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated", "spans", *(c for c in keep if c != "doc_id"))
    )
