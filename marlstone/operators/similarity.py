"""Vectors: means per path, graph edges, nearest neighbors and degrees by exact products of blocks of rows.

Blocks of rows meet as pairs of block numbers, an equi-join, so no task holds more than two blocks and no matrix is broadcast.
Blocks grow with the number of rows up to BLOCK_BYTES, since each of them travels to every other one. A pair of blocks is
multiplied a slice at a time and keeps its best few per row before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import sums_before

#: Rows of a block at least, bytes at most, and the blocks that rows are dealt to before blocks grow.
BLOCK, BLOCK_BYTES, BLOCKS = 1024, 16 << 20, 16
#: Products held at a time.
SLICE = 1 << 21


def blocks_of(vectors: DataFrame, size: int | None = None) -> tuple[DataFrame, int]:
    """block, ids, data: rows of vectors (id long, embedding) in numbered blocks of about `size`; data are unit float64 rows. And how many."""
    rows = vectors.select(F.col("id").cast("long"), F.col("embedding").cast("array<double>")).where("id IS NOT NULL AND embedding IS NOT NULL")
    count, dims = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if size is None:
        size = max(BLOCK, min(-(-count // BLOCKS), BLOCK_BYTES // (8 * max(1, dims or 1))))
    n = max(1, -(-count // size))

    def gather(t: pa.Table) -> pa.Table:
        x = np.array(t.column("embedding").to_pylist(), np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(norm == 0, 1, norm)
        ids = np.array(t.column("id").to_pylist(), np.int64)
        return pa.table({"block": t.column("block").slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([x.tobytes()], pa.binary())})

    return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).groupBy("block").applyInArrow(gather, "block int, ids binary, data binary"), n


def similar_pairs(vectors: DataFrame, threshold: float | None, top: int | None, ordered: bool, size: int | None = None, strict: bool = False, count: bool = False) -> DataFrame:
    """i, j, score for i != j (i < j if ordered): cosine at least (or, strict, above) threshold, the best `top` for each i, ties to the smaller j.

    A null threshold keeps all. The result is exact. With count, a pair of blocks gives each i once, with the number of its j as score.
    """
    blocks, n = blocks_of(vectors, size)

    def found(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = x @ y.T
        keep = (a[:, None] < b[None, :]) if ordered else (a[:, None] != b[None, :])
        if threshold is not None:
            keep &= (s > threshold) if strict else (s >= threshold)
        if count:
            many = keep.sum(axis=1)
            some = np.flatnonzero(many)
            return a[some], np.zeros(len(some), np.int64), many[some].astype(np.float64)
        if top is not None and len(b) > top:
            # What is below a row's last of the best cannot be among them; ties with it stay for the order.
            last = np.partition(np.where(keep, s, -np.inf), len(b) - top, axis=1)[:, len(b) - top]
            keep &= s >= last[:, None]
        i, j = np.nonzero(keep)
        if top is not None and len(i):
            order = np.lexsort((b[j], -s[i, j], i))
            i, j = i[order], j[order]
            head = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            rank = np.arange(len(i)) - np.repeat(head, np.diff(np.append(head, len(i))))
            i, j = i[rank < top], j[rank < top]
        return a[i], b[j], s[i, j]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}
                a, b = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ids2"], np.int64)
                x, y = np.frombuffer(row["data"], np.float64).reshape(len(a), -1), np.frombuffer(row["data2"], np.float64).reshape(len(b), -1)
                step = max(1, SLICE // len(b))
                for at in range(0, len(a), step):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in found(a[at : at + step], x[at : at + step], b, y)], names=["i", "j", "score"])

    # Each block meets every block once, as an equi-join on the other's number.
    left = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = blocks.select(F.col("block").alias("other"), F.col("ids").alias("ids2"), F.col("data").alias("data2"))
    pairs = left.join(right, "other").select("ids", "data", "ids2", "data2").mapInArrow(multiply, "i long, j long, score double")
    if top is None:
        return pairs
    best = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "j"))
    return pairs.withColumn("rank", best).where(F.col("rank") <= top).drop("rank")


def degrees(vectors: DataFrame, threshold: float = 0.5, size: int | None = None) -> DataFrame:
    """id, degree: how many others have a cosine above threshold, for every id."""
    found = similar_pairs(vectors, threshold, None, False, size, strict=True, count=True).groupBy("i").agg(F.sum("score").cast("long").alias("degree"))
    return vectors.select("id").join(found.withColumnRenamed("i", "id"), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def path_vectors(chunks: DataFrame) -> DataFrame:
    """path, ordinal (of first appearance by chunk_seq), embedding: the unit mean of each path's vectors; zero means stay zero."""
    long = chunks.select("path", "chunk_seq", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "x"))
    mean = long.groupBy("path", "k").agg(F.avg("x").alias("x")).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda v: v["x"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = mean.select("path", F.transform("v", lambda x: x / F.when(norm == 0, 1.0).otherwise(norm)).alias("embedding"))
    first = chunks.groupBy("path").agg(F.min("chunk_seq").alias("first"))
    ordinal = first.select("path", "first").join(sums_before(first.select("first", F.lit(1).alias("n")), "first", "n").withColumnRenamed("before", "ordinal"), "first")
    return unit.join(ordinal, "path").select("path", F.col("ordinal").cast("long").alias("ordinal"), "embedding")


def similarity_edges(paths: DataFrame, threshold: float = 0.7, top: int = 5) -> DataFrame:
    """i, j, score of paths by ordinal: i < j, cosine at least threshold, the best `top` of each i."""
    return similar_pairs(paths.select(F.col("ordinal").alias("id"), "embedding"), threshold, top, True)


def degree_rank(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree, rank: each node's edges at either end, and its share of all ends, to 4 places."""
    ends = edges.select(F.col("i").alias("id")).unionAll(edges.select(F.col("j").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    total = ends.agg(F.greatest(F.coalesce(F.sum("degree"), F.lit(0)), F.lit(1)).alias("total"))
    rows = nodes.select("id").join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return rows.join(F.broadcast(total)).select("id", "degree", F.round(F.col("degree") / F.col("total"), 4).alias("rank"))


def neighbors(vectors: DataFrame, k: int = 3, above: float = 0.3) -> DataFrame:
    """i, j, score: the best k others of each, then those above the threshold."""
    return similar_pairs(vectors, None, k, False).where(F.col("score") > above)


def centroid_and_uniqueness(vectors: DataFrame) -> DataFrame:
    """id, centroid (cosine to the mean vector, 0 at least), uniqueness (1 less the mean cosine to the others, own one included)."""
    rows = vectors.select(F.col("id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = rows.select("id", "v", F.transform("v", lambda x: x / F.when(norm == 0, 1.0).otherwise(norm)).alias("u"))
    sums = unit.select(F.posexplode(F.arrays_zip("v", "u")).alias("k", "p")).groupBy("k").agg(F.avg("p.v").alias("m"), F.sum("p.u").alias("s"), F.count("*").alias("n"))
    whole = sums.agg(F.array_sort(F.collect_list(F.struct("k", "m", "s"))).alias("t"), F.max("n").alias("n"))
    whole = whole.select(F.transform("t", lambda x: x["m"]).alias("m"), F.transform("t", lambda x: x["s"]).alias("s"), "n")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    length = F.sqrt(dot("m", "m"))
    joined = unit.join(F.broadcast(whole))  # one row, of the vectors' width
    centroid = F.greatest(F.lit(0.0), dot("u", "m") / F.when(length == 0, 1.0).otherwise(length))
    unique = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), 1 - dot("u", "s") / F.nullif(F.col("n") - 1, F.lit(0)))).otherwise(0.0)
    return joined.select("id", centroid.alias("centroid"), unique.alias("uniqueness"))
