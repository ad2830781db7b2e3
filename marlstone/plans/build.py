"""The whole plan, from a source to a pack: files, chunks, embeddings, graph, scores, documentation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import scoring, similarity
from ..sources import files as file_sources
from ..sources import pack
from . import documents, embedding
from .ingestors import Registry, default_registry, sequenced


@dataclass
class Config:
    """What a build does; one place for all defaults."""

    source: str
    branch: str = "main"
    ingestor: str | None = None
    code_chunk_size: int = 240
    text_chunk_size: int = 500
    embedder: str = "hash-384"
    edge_threshold: float = 0.7
    edges_per_file: int = 5
    neighbors: int = 3
    neighbor_threshold: float = 0.3
    score_threshold: float | None = None
    model: str | None = None
    max_documented: int | None = None
    workers: int = 8
    weights: tuple[float, float, float] = field(default=(0.5, 0.35, 0.15))


@dataclass
class Result:
    """Lazy tables of a build, and its choices."""

    domain: str
    ingestor: str
    files: DataFrame
    chunks: DataFrame
    embeddings: DataFrame
    nodes: DataFrame
    edges: DataFrame
    scored: DataFrame
    docs: DataFrame
    statistics: DataFrame
    usage: DataFrame | None = None


def build(spark: SparkSession, config: Config, files: DataFrame | None = None, generator: documents.Generator | None = None, registry: Registry | None = None) -> Result:
    """Tables of a pack from config.source, or from files (path, content, size). Without a generator, docs are rule-based."""
    files = file_sources.read_source(spark, config.source) if files is None else files
    chosen = (registry or default_registry(config.code_chunk_size, config.text_chunk_size)).select(files, config.ingestor)
    chunks = sequenced(chosen.chunks(files), files).persist()
    vectors = embedding.embedded(chunks, config.embedder).persist()
    paths = similarity.path_vectors(chunks.select("chunk_seq", "path").join(vectors, "chunk_seq")).persist()
    edges = similarity.similarity_edges(paths, config.edge_threshold, config.edges_per_file).persist()
    ranks = similarity.degree_rank(paths.select(F.col("ordinal").alias("id")), edges).join(paths.select(F.col("ordinal").alias("id"), "path"), "id")
    nodes = ranks.select("id", F.lit("file").alias("type"), S.basename(F.col("path")).alias("name"), "path", F.lit(chosen.domain).alias("domain"), F.col("rank").alias("pagerank"))
    semantic = scoring.semantic_scores(vectors.select(F.col("chunk_seq").alias("id"), "embedding"))
    scored = scoring.doc_scores(chunks, semantic, ranks.select("path", "rank"), config.score_threshold, config.weights).persist()
    docs, usage = scoring.rule_based_docs(chunks), None
    if generator is not None:
        # The filter and the limit stand before the model is asked.
        asked = scoring.worthy_or_all(scored)
        if config.max_documented is not None:
            asked = scoring.best(asked, config.max_documented)
        near = similarity.neighbors(vectors.select(F.col("chunk_seq").alias("id"), "embedding"), config.neighbors, config.neighbor_threshold)
        results = documents.generated(documents.prompts(asked, scoring.neighbor_context(near, chunks)), generator, config.workers).persist()
        docs, usage = documents.documentation(results, chunks), documents.totals(results, config.model or "gpt-5-nano")
    return Result(chosen.domain, chosen.name, files, chunks, vectors, nodes, edges, scored, docs, scoring.score_statistics(scored, config.score_threshold), usage)


def write(result: Result, config: Config, path: str) -> str:
    """The pack as one zip."""
    dims = result.embeddings.select(F.size("embedding")).first()
    m = pack.manifest(result.files, result.chunks, {"location": config.source}, result.domain, result.ingestor, dims[0] if dims else 0, config.embedder, result.statistics)
    return pack.write_pack(path, m, file_sources.tree(result.files), result.chunks, result.embeddings, result.nodes, result.edges, result.docs)
