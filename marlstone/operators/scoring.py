"""Importance of chunks from structure, meaning and complexity, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import similarity

THRESHOLD = 0.65


def semantic_scores(vectors: DataFrame, above: float = 0.5) -> DataFrame:
    """id, degree_score, centroid, uniqueness, semantic: 0.4 degree over the largest, 0.4 centroid, 0.2 uniqueness."""
    deg = similarity.degrees(vectors, above)
    most = deg.agg(F.greatest(F.coalesce(F.max("degree"), F.lit(0)), F.lit(1)).alias("most"))
    deg = deg.join(F.broadcast(most)).select("id", (F.col("degree") / F.col("most")).alias("degree_score"))
    both = deg.join(similarity.centroid_and_uniqueness(vectors), "id")
    return both.withColumn("semantic", 0.4 * F.col("degree_score") + 0.4 * F.col("centroid") + 0.2 * F.col("uniqueness"))


def doc_scores(chunks: DataFrame, semantic: DataFrame | None = None, ranks: DataFrame | None = None, threshold: float | None = None, weights: tuple[float, float, float] = (0.5, 0.35, 0.15)) -> DataFrame:
    """chunks (chunk_seq, path, type, text, depth, visibility, line_start, line_end) with their parts, score and doc_worthy.

    semantic (id, semantic) and ranks (path, rank) are joined by key; without them they count 0. doc_worthy tests the unrounded score.
    """
    limit = THRESHOLD if threshold is None else threshold
    rows = chunks
    if semantic is not None:
        rows = rows.join(semantic.select(F.col("id").alias("chunk_seq"), "semantic"), "chunk_seq", "left")
    rows = rows.withColumn("semantic", F.coalesce("semantic", F.lit(0.0)) if semantic is not None else F.lit(0.0))
    if ranks is not None:
        rows = rows.join(ranks.select("path", "rank"), "path", "left").withColumn("semantic", S.boosted(F.col("semantic"), F.coalesce("rank", F.lit(0.0)))).drop("rank")
    rows = rows.withColumn("structural", S.structural_score(F.col("type"), F.coalesce("depth", F.lit(0)), F.col("visibility")))
    line = [F.coalesce(c, F.lit(0)) for c in ("line_start", "line_end")]
    rows = rows.withColumn("complexity", S.complexity_score(F.coalesce("text", F.lit("")), *line))
    raw = S.weighted_score(F.col("structural"), F.col("semantic"), F.col("complexity"), weights)
    return rows.withColumn("raw_score", raw).withColumn("score", F.round("raw_score", 4)).withColumn("doc_worthy", F.col("raw_score") >= limit)


def worthy(scored: DataFrame, threshold: float | None = None) -> DataFrame:
    """Chunks whose rounded score reaches the threshold."""
    return scored.where(F.col("score") >= (THRESHOLD if threshold is None else threshold))


def worthy_or_all(scored: DataFrame) -> DataFrame:
    """Chunks flagged worthy, or all of them if none is."""
    any_ = scored.agg(F.coalesce(F.max("doc_worthy"), F.lit(False)).alias("any"))
    return scored.join(F.broadcast(any_)).where("doc_worthy OR NOT any").drop("any")


def score_statistics(scored: DataFrame, threshold: float | None = None) -> DataFrame:
    """One row: count, mean, median, min, max, deviation, percentiles, and the worthy ones by the rounded score."""
    s, limit = F.col("score"), THRESHOLD if threshold is None else threshold
    p = {f"p{q}": F.percentile("score", F.lit(q / 100)) for q in (25, 50, 75, 90, 95)}
    n = F.count_if(s >= limit)
    return scored.agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), F.median("score").alias("median"), F.min("score").alias("low"), F.max("score").alias("high"), F.stddev_pop("score").alias("deviation"),
        *[c.alias(k) for k, c in p.items()], n.alias("n_worthy"), (100.0 * n / F.nullif(F.count("*"), F.lit(0))).alias("percent_worthy"),
    )


def first_per_path(chunks: DataFrame) -> DataFrame:
    """The first chunk of each path by chunk_seq."""
    return chunks.withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy("chunk_seq"))).where("rn = 1").drop("rn")


def best(scored: DataFrame, n: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "chunk_seq").limit(n)


def spread(chunks: DataFrame, n: int) -> DataFrame:
    """n chunks: the first of each path first, then the rest in order."""
    rn = F.row_number().over(Window.partitionBy("path").orderBy("chunk_seq"))
    return chunks.withColumn("rn", rn).orderBy(F.col("rn") > 1, "chunk_seq").limit(n).drop("rn")


def rule_based_docs(chunks: DataFrame) -> DataFrame:
    """symbol_id, summary, description per path."""
    return first_per_path(chunks).select(F.concat(F.lit("file:"), "path").alias("symbol_id"), F.concat(F.lit("File: "), "path").alias("summary"), S.preview(F.col("text")).alias("description"))


def neighbor_context(found: DataFrame, chunks: DataFrame, length: int = 200) -> DataFrame:
    """id, context: each neighbor's path, type and beginning, best first; neighbors without a chunk are left out."""
    told = F.concat(F.lit("- "), "path", F.lit(" ("), "type", F.lit(", "), F.format_string("%.4f", "score"), F.lit("): "), F.substring("text", 1, length))
    rows = found.join(chunks.select(F.col("chunk_seq").alias("j"), "path", "type", "text"), "j").select("i", F.struct((-F.col("score")).alias("s"), "j", told.alias("t")).alias("x"))
    return rows.groupBy(F.col("i").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("context"))
