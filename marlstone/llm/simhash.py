"""SimHash near-duplicates: 64-bit fingerprints of word shingles, joined with themselves by pairs of binary-trie nodes.

Fingerprints within `distance` bits agree wholly in one of distance + 1 bit blocks. Each distinct fingerprint goes, once per
block, to the group of its block's value, where the trie over the remaining bits is joined with itself: node pairs descend
together, differing bits add up, and a pair that exceeds the budget goes. A group's links leave its task as a spanning forest
(at most one edge per fingerprint), never as all pairs. Components come from alternating large-star and small-star rounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, drop_settled, encoded, free_shuffles, lean, settle
from .lookup import mix

SEED = 42
#: Shingles hashed at a time; longer texts are counted in several runs.
CHUNK = 1 << 17
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _counts(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many of each owner's hashes have each bit, (n, 64)."""
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    out = np.empty((n, 64), np.int64)
    for j in range(8):
        out[:, 8 * j : 8 * j + 8] = np.bincount(owner * 256 + by_byte[:, j], minlength=n * 256).reshape(n, 256) @ _BITS
    return out


def fingerprints_of(texts: list[str | None], shingle: int) -> np.ndarray:
    """uint64 fingerprints. A bit is 1 if more than half the shingle hashes have it; no words: 0."""
    from xxhash import xxh64_intdigest as digest

    counts, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    found: list[int] = []
    owner: list[tuple[int, int]] = []

    def count() -> None:
        if found:
            who, many = np.array(owner).T
            first = who[0]
            hashes, whose = np.array(found, np.uint64), np.repeat(who - first, many)
            counts[first : who[-1] + 1] += _counts(hashes, whose, int(who[-1] - first + 1))
            found.clear()
            owner.clear()

    for i, text in enumerate(texts):
        words = encoded(text).translate(LOWER).split()
        if not words:
            continue
        shingles = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else iter([tuple(words)])
        totals[i] = max(1, len(words) - shingle + 1)
        left = int(totals[i])
        while left:
            room = min(left, CHUNK)
            found.extend([digest(b" ".join(s), SEED) for s in islice(shingles, room)])
            owner.append((i, room))
            left -= room
            if len(found) >= CHUNK:
                count()
    count()
    bits = (2 * counts > totals[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), row for row; null, empty and blank texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fp = fingerprints_of(part.column(1).to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, fp long")


def _join_nodes(
    keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, free_bits: int, allowed: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], owner: np.ndarray | None = None, chunk: int = 1 << 19
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of keys for which near(i, j) holds, from trie nodes [lo, hi), each of sorted keys that share all but free_bits bits.

    Two nodes descend together, their differing bits add up, and a pair of nodes goes when it has more of them than allowed[n]
    after n bits, or when all below both has the same owner. Node pairs of one level are handled together; a work list of chunks,
    deepest first, bounds the memory.
    """
    change = np.cumsum(np.r_[0, owner[1:] != owner[:-1]]) if owner is not None else None
    ones: dict[int, np.ndarray] = {}
    work = [(free_bits, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while work:
        depth, a0, a1, b0, b1, err = work.pop()
        if len(a0) > chunk:
            half = len(a0) // 2
            work.append((depth, a0[half:], a1[half:], b0[half:], b1[half:], err[half:]))
            work.append((depth, a0[:half], a1[:half], b0[:half], b1[:half], err[:half]))
            continue
        area = (a1 - a0) * (b1 - b0)
        leaf = (area <= 16) | (depth == 0)
        for at in _runs(area[leaf], chunk * 4):
            x0, x1, y0, y1 = (v[leaf][at] for v in (a0, a1, b0, b1))
            many = (x1 - x0) * (y1 - y0)
            own = np.repeat(np.arange(len(many)), many)
            k = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
            width = (y1 - y0)[own]
            i, j = x0[own] + k // width, y0[own] + k % width
            open_ = (i < j) if owner is None else (i < j) & (owner[i] != owner[j])
            i, j = i[open_], j[open_]
            good = near(i, j)
            if good.any():
                yield i[good], j[good]
        if leaf.all():
            continue
        a0, a1, b0, b1, err = (v[~leaf] for v in (a0, a1, b0, b1, err))
        if depth not in ones:
            if len(ones) >= 4:
                ones.clear()
            ones[depth] = np.cumsum(np.r_[0, (keys >> np.uint64(depth - 1)).astype(np.int64) & 1])
        up = ones[depth]
        am, bm = a1 - (up[a1] - up[a0]), b1 - (up[b1] - up[b0])
        same = a0 == b0
        parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), *[tuple(v[~same] for v in (am, a1, b0, bm, err + 1))]]
        x = [np.concatenate(v) for v in zip(*parts, strict=True)]
        live = (x[0] < x[1]) & (x[2] < x[3]) & (x[4] <= allowed[free_bits - depth + 1])
        x = [v[live] for v in x]
        if change is not None and len(x[0]):
            mixed = (owner[x[0]] != owner[x[2]]) | (change[x[0]] != change[x[1] - 1]) | (change[x[2]] != change[x[3] - 1])
            x = [v[mixed] for v in x]
        if len(x[0]):
            work.append((depth - 1, *x))


def _runs(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive entries whose sizes add up to about `most`."""
    if len(sizes):
        run = np.cumsum(sizes) // most
        cuts = np.flatnonzero(np.diff(run)) + 1
        for s, e in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
            yield slice(s, e)


def _rooted(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Hook the roots of i and j together, smaller index first, until each pair has one root."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (a, b) between `rep` ids of the distinct fingerprints in nodes (rep long, fp long) that connect all that link.

    Two fingerprints within `distance` bits are connected by the edges; edges per task are at most its rows.
    """
    blocks = distance + 1
    width = -(-64 // blocks)
    starts = [min(64 - width, k * width) for k in range(blocks)]

    def turned(fp: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The block that begins at bit `start` from the top becomes the top."""
        s = start.astype(np.uint64)
        return np.where(start == 0, fp, (fp << s) | (fp >> ((np.uint64(64) - s) & np.uint64(63))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        block, rep, fp = (rows.column(n).to_numpy() for n in ("block", "rep", "fp"))
        for k in range(blocks):
            mine = block == k
            keys = turned(fp[mine].view(np.uint64), np.full(mine.sum(), starts[k]))
            order = np.argsort(keys)
            keys, ids = keys[order], rep[mine][order]
            if len(keys) < 2:
                continue
            cut = np.flatnonzero(np.diff(keys >> np.uint64(64 - width))) + 1
            lo, hi = np.r_[0, cut], np.r_[cut, len(keys)]
            many = hi - lo > 1
            label = np.arange(len(keys))
            near = lambda i, j, keys=keys: np.bitwise_count(keys[i] ^ keys[j]) <= distance
            for i, j in _join_nodes(keys, lo[many], hi[many], 64 - width, np.full(65, distance), near):
                _rooted(label, i, j)
            tied = np.flatnonzero(label != np.arange(len(keys)))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[label[tied]])], names=["a", "b"])

    at = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.shiftleft("fp", s), 64 - width).alias("value")) for k, s in enumerate(starts)]
    spread = nodes.select("rep", "fp", F.explode(F.array(*at)).alias("t")).select("rep", "fp", "t.block", "t.value")
    return spread.repartition(F.col("block"), F.col("value")).select("block", "rep", "fp").mapInArrow(lean(run), "a long, b long")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, component (the smallest id reachable) of every node in edges (a, b), by large-star and small-star rounds.

    Each round is written to the shared folder; rounds end when the edges no longer change, which takes about as many as the
    logarithm of the largest component. RuntimeError if they still do after most_rounds.
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    for _ in range(most_rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        before, edges = edges, settle(small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct(), "edges")
        drop_settled(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == sign:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        sign = now
    raise RuntimeError(f"components still change after {most_rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row per input row.

    Null or blank texts have fingerprint zero and link like any other. Repeated rows and texts share a fingerprint and so a
    component. Rows whose doc_id is null get the component of their fingerprint, null if no other row has an id. An empty
    table gives no rows. Other columns of docs are not read.
    """
    fps = settle(fingerprints(docs, shingle), "fingerprints")
    nodes = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"), "nodes")
    tied = components(links(nodes, distance))
    named = nodes.join(tied.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Of this share of the documents shingles are counted, to tell common ones; this only orders shingles, results never depend on it.
COUNTED = 16
#: Common shingles told to the tasks at most, and pairs or rows that one step of a task makes.
MOST_COMMON, STEP = 1 << 20, 1 << 18
#: 64-bit parts of the signatures with which similar texts are searched for.
PARTS = 8
#: Sets of fewer shingles than this count as small: their bits differ more often than a long text's.
SMALL = 16


def _shingles(text: str | None, shingle: int) -> Iterator[tuple[bytes, ...]]:
    words = encoded(text).translate(LOWER).split()
    if len(words) >= shingle:
        return zip(*(words[k:] for k in range(shingle)), strict=False)
    return iter([tuple(words)] if words else [])


def _hashed(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles' hashes of 60 bits, sorted."""
    from xxhash import xxh64_intdigest as digest

    return np.unique(np.fromiter((digest(b" ".join(s), SEED) >> 4 for s in _shingles(text, shingle)), np.int64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """uint64 SimHash signatures of PARTS words, (n, PARTS), of sets of hashes."""
    counts, at = np.zeros((PARTS, len(sets), 64), np.int64), 0
    sizes = np.array([len(x) for x in sets], np.int64)
    while at < len(sets):
        end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK)) + at)
        flat, own = np.concatenate(sets[at:end]).astype(np.uint64), np.repeat(np.arange(end - at), sizes[at:end])
        for k in range(PARTS):
            counts[k, at:end] = _counts(mix(flat + np.uint64((0xD6E8FEB86659FD93 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)), own, end - at)
        at = end
    return np.packbits((2 * counts > sizes[:, None]).astype(np.uint8), axis=2, bitorder="little").view(np.uint64)[:, :, 0].T.copy()


def bit_budget(bits: int | np.ndarray, similarity: float, small: bool | np.ndarray = False, deviations: float = 4.5) -> np.ndarray:
    """How many of so many signature bits two sets with that Jaccard similarity may differ in.

    A bit of two sets of equal size differs with the chance that their angle has of half a turn; for sets of a few shingles, of
    which there are as many as can tie, it was found to be up to 0.04 more. The budget is `deviations` standard deviations above
    the mean, so fewer than one pair in 10^5 exceeds it.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi + np.where(small, 0.04, 0.01)
    return np.ceil(bits * p + deviations * np.sqrt(bits * p * (1 - p))).astype(np.int64)


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of shingles that many of the counted documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_hashed(t, shingle) for t in batch.column(0).to_pylist()]
            if found:
                k, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k[n > 1]), pa.array(n[n > 1])], names=["k", "c"])

    some = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0)
    most = some.mapInArrow(lean(run), "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).where("c > 2").orderBy(F.desc("c"), "k").limit(MOST_COMMON)
    return np.sort(np.array([r.k for r in most.select("k").collect()], np.int64))


def _prefix(n: int, similarity: float) -> int:
    """Of n shingles in the common order, how many first ones any set `similarity` alike must meet."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _alike(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts' sets of shingles have a Jaccard similarity of `similarity` or more, by the shingles themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for k in range(batch.num_rows):
                x, y = (set(_shingles(batch.column(c)[k].as_py(), shingle)) for c in (2, 3))
                both = len(x & y)
                good.append(both > 0 and both / (len(x) + len(y) - both) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in (0, 1)], names=["a", "b"])

    x, y = (texts.select(F.col("node").alias(c), F.col("text").alias("text_" + c)) for c in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b").mapInArrow(lean(run), "a long, b long")


def similar_links(docs: DataFrame, signed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges (a, b) between nodes of signed that connect all texts `similarity` alike or more, and no others.

    Two sets that much alike share a shingle among the first n - ceil(similarity * n) + 1 of each in any one order, so the groups
    of nodes that share one of these (rows of `met`) hold every pair. First each node is tried with the node it meets most often
    as the least of a group, which ties large groups of near copies at one comparison a node. Then each group's binary trie of
    signatures is joined with itself: node pairs go that exceed the budget of differing bits, or whose nodes are all tied
    already; and pairs of which one has too few shingles from the group's one on (for the first one in common they are enough
    where a pair is similar). What is left is compared by its shingles.
    """
    nodes = signed.where("doc_id IS NOT NULL AND n > 0")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        k, node, place = (rows.column(c).to_numpy() for c in ("k", "node", "place"))
        order = np.lexsort((node, k))
        k, node, place = k[order], node[order], place[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (node[1:] != node[:-1])]
        k, node, place = k[new], node[new], place[new]
        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[start, len(k)])
        many = np.repeat(size, size) > 1
        lead = np.repeat(node[start], size)
        for at in range(0, len(k), STEP):
            s = slice(at, at + STEP)
            yield pa.RecordBatch.from_arrays([pa.array(v[s][many[s]]) for v in (k, node, place, lead)], names=["k", "node", "place", "lead"])

    spread = nodes.select("node", F.posexplode("first").alias("place", "k"))
    met = settle(spread.repartition("k").mapInArrow(lean(meet), "k long, node long, place int, lead long"), "met", "zstd")
    known = nodes.groupBy("node").agg(F.min("n").alias("n"), F.min("text_hash").alias("text_hash"), F.first("sig").alias("sig"))
    sizes = settle(known.join(met.select("node").distinct(), "node", "left_semi"), "met-sizes")

    def texts(pairs: DataFrame) -> DataFrame:
        want = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(sizes, "node").select("node", "text_hash")
        have = docs.select(F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
        return have.join(want, "text_hash").dropDuplicates(["node"]).select("node", "text")

    most = met.where("node <> lead").groupBy("node", "lead").agg(F.count("*").alias("c")).groupBy("node").agg(F.max(F.struct("c", "lead")).alias("m"))
    tries = settle(most.join(sizes, "node").where("m.c * 20 >= n").select(F.col("node").alias("a"), F.col("m.lead").alias("b")), "tries")
    free_shuffles(docs.sparkSession)
    sure = settle(_alike(tries, texts(tries), shingle, similarity), "sure-links")
    tied = components(sure)
    budget = [int(bit_budget(64 * PARTS, similarity, small)) for small in (False, True)]
    by_depth = bit_budget(np.arange(65), similarity, True)

    def pair(batches: Iterator[pa.RecordBatch], nearest: bool) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got).combine_chunks()
        k, node, place, n, owner = (rows.column(c).to_numpy() for c in ("k", "node", "place", "n", "component"))
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint64).reshape(-1, PARTS)
        order = np.lexsort((sig[:, 0], k))
        k, node, n, owner, sig = k[order], node[order], n[order], owner[order], sig[order]
        left = n - place[order]
        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        stop = np.r_[start[1:], len(k)]

        def bits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return np.concatenate([np.bitwise_count(sig[i[s : s + STEP]] ^ sig[j[s : s + STEP]]).sum(1) for s in range(0, max(1, len(i)), STEP)])

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            good = (low >= similarity * high - 1e-6) & (np.minimum(left[i], left[j]) >= (low + high) * (similarity / (1 + similarity)) - 1e-6)
            at = np.flatnonzero(good)
            good[at] = bits(i[at], j[at]) <= np.where(low[at] < SMALL, budget[1], budget[0])
            return good

        def out(two: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1])], names=["a", "b"])

        held: list[np.ndarray] = []
        if nearest:
            names, who = np.unique(node, return_inverse=True)
            best, partner = np.full(len(names), 1 << 20), np.zeros(len(names), np.int64)
        for i, j in _join_nodes(sig[:, 0], start, stop, 64, by_depth, near, owner):
            if nearest:
                d = bits(i, j)
                for x, y in ((i, j), (j, i)):
                    by = np.lexsort((node[y], d, who[x]))
                    head = by[np.r_[True, who[x][by][1:] != who[x][by][:-1]]]
                    w = who[x][head]
                    closer = d[head] < best[w]
                    best[w[closer]], partner[w[closer]] = d[head][closer], node[y][head][closer]
                continue
            held.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1))
            if sum(map(len, held)) >= STEP:
                held = [np.unique(np.concatenate(held), axis=0)]
                if len(held[0]) >= STEP // 2:
                    yield out(held.pop())
        if nearest and (found := np.flatnonzero(best < 1 << 20)).size:
            held.append(np.sort(np.stack([names[found], partner[found]], axis=1), axis=1))
        if held:
            yield out(np.unique(np.concatenate(held), axis=0))

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got).combine_chunks()
        _, which = np.unique(rows.column("k").to_numpy(), return_inverse=True)
        owner = rows.column("component").to_numpy()
        low, high = np.full(which.max() + 1, np.iinfo(np.int64).max), np.full(which.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, which, owner)
        np.maximum.at(high, which, owner)
        yield from rows.filter(pa.array((low < high)[which])).to_batches(max_chunksize=STEP)

    links_so_far, open_ = sure, met.select("k", "node", "place")
    for nearest in (True, True, False):
        free_shuffles(docs.sparkSession)
        # Only groups of which not all nodes are tied are gone on with; signatures travel for these alone.
        owned = open_.join(tied, "node", "left").select("k", "node", "place", F.coalesce("component", "node").alias("component"))
        left = settle(owned.repartition("k").mapInArrow(lean(mixed), "k long, node long, place int, component long"), "open-groups", "zstd")
        told = left.join(sizes.select("node", "n", "sig"), "node").select("k", "node", "place", "n", "component", "sig")
        pairs = settle(told.repartition("k").mapInArrow(lean(lambda batches, nearest=nearest: pair(batches, nearest)), "a long, b long").distinct(), "candidates")
        open_ = left.drop("component")
        good = settle(_alike(pairs, texts(pairs), shingle, similarity), "links")
        links_so_far = links_so_far.unionByName(good)
        if nearest:
            tied = components(links_so_far)
    return links_so_far


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id, text_hash, group, row for row: groups of texts tied by an exact Jaccard similarity of word shingles of `similarity` or more.

    Texts of fewer words are one shingle. Null and blank texts are all alike. Rows whose doc_id is null tie no others; they get
    the component of their set of shingles, null if no other row has an id. component_id is the group's smallest doc_id, group
    tells groups apart also where all doc_ids are null, text_hash is xxhash64(text).
    """
    from xxhash import xxh64_intdigest as digest

    common = docs.sparkSession.sparkContext.broadcast(_common(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = common.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [_hashed(text, shingle) for text in part.column(1).to_pylist()]
                nodes, first = [digest(own.tobytes(), SEED) for own in sets], []
                for own in sets:
                    if len(often):
                        place = np.minimum(np.searchsorted(often, own), len(often) - 1)
                        own = np.sort(own | ((often[place] == own).astype(np.int64) << 60))
                    first.append(own[: _prefix(len(own), similarity)])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, first)]), pa.int32()), pa.array(np.concatenate(first)))
                sigs = pa.array([x.tobytes() for x in signatures(sets)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array([len(x) for x in sets], pa.int64()), sigs, lists], names=["doc_id", "text_hash", "node", "n", "sig", "first"]
                )

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text)).mapInArrow(lean(run), "doc_id long, text_hash long, node long, n long, sig binary, first array<long>")
    signed = settle(rows, "shingled", "zstd")
    links_ = similar_links(docs, signed, shingle, similarity)
    free_shuffles(docs.sparkSession)
    tied = components(links_)
    named = signed.groupBy("node").agg(F.min("doc_id").alias("rep")).join(tied, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("group"))
    lowest = named.groupBy("group").agg(F.min("rep").alias("component_id"))
    return signed.select("doc_id", "node", "text_hash").join(named.join(lowest, "group").select("node", "group", "component_id"), "node", "left").select("doc_id", "component_id", "text_hash", "group")
