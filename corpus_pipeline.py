"""The corpus pipeline: documents to packed training sequences, stage by stage.

Each stage gets all that its predecessor kept, as a table written and read again; all but the last return the columns of
documents. Stages that look back at other tables read them from sf_dir.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import free_shuffles, settle, table
from marlstone.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _begin(spark: SparkSession) -> None:
    """Ship the package, and let go of the shuffles, broadcasts and plans of the stage before."""
    ship(spark)
    free_shuffles(spark)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; each row has its own verdict, whatever its doc_id."""
    from marlstone.llm.cotraining import classify

    _begin(spark)
    return classify(docs, table(spark, sf_dir, "labels"), rows_too=True).where("accepted").select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; five-word shingles, 0.8 alike or more.

    The one with the smallest doc_id stays; of several rows with that doc_id one of those with the smallest hash of text, and one
    without a doc_id only where no row of the group has one. Rows go by doc_id and text, so other texts under the same doc_id stay.
    """
    from marlstone.llm.simhash import similar_groups

    _begin(spark)
    groups = settle(similar_groups(docs, shingle=5, similarity=0.8), "groups")
    free_shuffles(spark)
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f"))
    found = settle(first.select(F.col("f.doc_id").alias("sn_id"), F.col("f.text_hash").alias("sn_hash")), "kept-rows")
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("hash"))
    kept = rows.join(found, F.col("doc_id").eqNullSafe(F.col("sn_id")) & (F.col("hash") == F.col("sn_hash")), "left_semi")
    copies = groups.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("sn_id"), F.col("text_hash").alias("sn_hash"))
    if copies.isEmpty():
        return kept.select(*COLUMNS)
    # Rows alike in doc_id and text: one of them stays.
    again = F.col("doc_id").eqNullSafe(F.col("sn_id")) & (F.col("hash") == F.col("sn_hash"))
    return kept.join(copies, again, "left_anti").unionByName(kept.join(copies, again, "left_semi").dropDuplicates(["doc_id", "hash"])).select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that an earlier one has; gone where nothing is left of a text."""
    from marlstone.llm.suffix_dedup import repeated_spans

    _begin(spark)
    spans = repeated_spans(docs, length=50, text_too=True).where("n_removed > 0")
    changed = settle(spans.select(F.col("doc_id").alias("ms_id"), F.col("text_hash").alias("ms_hash"), F.col("kept").alias("ms_left")).dropDuplicates(["ms_id", "ms_hash"]), "cut-texts", "zstd")
    rest = docs.select(*COLUMNS).join(changed, F.col("doc_id").eqNullSafe(F.col("ms_id")) & (F.xxhash64("text") == F.col("ms_hash")), "left")
    cut = F.col("ms_left").isNotNull()
    n_chars = F.when(cut, F.length("ms_left").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return rest.where("ms_left IS NULL OR ms_left <> ''").select("doc_id", F.coalesce("ms_left", "text").alias("text"), "lang", "source", n_chars)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are in windows of 13 benchmark words; each row has its own verdict."""
    from marlstone.llm.fmindex import contamination

    _begin(spark)
    return contamination(docs, table(spark, sf_dir, "benchmark"), width=13, keep=COLUMNS).where("NOT contaminated").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    import public_tokenizers

    from marlstone.llm.packing import pack

    _begin(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the classifier, the tokenizer or the packing; the pipeline is tested against plain re-statements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"stage-{k}", "zstd")
    return docs
