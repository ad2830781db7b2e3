"""Files as rows: directories, zip archives, trees, decoding, float32 binaries."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalar as S

MOST_BYTES = 1_000_000


def wanted(path: Column, size: Column) -> Column:
    """The rule for all sources: no skipped directory in the relative path, no more than MOST_BYTES."""
    return ~S.in_directory(path, fixed.SKIPPED_DIRECTORIES) & (size <= MOST_BYTES)


def walked(path: Column) -> Column:
    """The ingest walk's rule: no hidden name, none of its skipped directories."""
    return ~F.exists(F.split(path, "/"), lambda p: p.startswith(".")) & ~S.in_directory(path, fixed.WALK_SKIPPED)


def read_directory(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), content, size of a directory's files, or of one file by its name. The size test reaches the listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= MOST_BYTES)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = system.makeQualified(hadoop)
    # The listing gives whole paths; what stands before the relative one is the root's own, whatever names it holds.
    base = len(whole.toString().rstrip("/")) + 2
    rel = S.basename(F.col("path")) if system.getFileStatus(whole).isFile() else F.substring(F.col("path"), F.lit(base), F.length("path"))
    rows = files.select(rel.alias("path"), "content", F.col("length").alias("size"))
    return rows.where(wanted(F.col("path"), F.col("size")))


def unzipped(archives: DataFrame) -> DataFrame:
    """archive, path, content, size of the members of zip archives (path, content); unsafe names and unreadable members are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except (zipfile.BadZipFile, TypeError):
                    continue
                for m in z.infolist():
                    if m.is_dir() or m.filename.startswith("/") or ".." in m.filename.split("/"):
                        continue
                    try:
                        data = z.read(m)
                    except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([m.filename]), pa.array([data], pa.binary()), pa.array([len(data)])], names=["archive", "path", "content", "size"])

    return archives.select("path", "content").mapInArrow(run, "archive string, path string, content binary, size long")


def rooted(members: DataFrame) -> DataFrame:
    """members with the top directory taken off where an archive has just one entry at its top and that is a directory."""
    top = F.split("path", "/")[0]
    tops = members.groupBy("archive").agg(F.min(top).alias("a"), F.max(top).alias("b"), F.min(F.size(F.split("path", "/"))).alias("depth"))
    joined = members.join(tops, "archive")
    alone = (F.col("a") == F.col("b")) & (F.col("depth") > 1)
    return joined.withColumn("path", F.when(alone, F.substring(F.col("path"), F.length("a") + 2, F.length("path"))).otherwise(F.col("path"))).drop("a", "b", "depth")


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """path, content, size of a zip archive's members, by the rule for all sources."""
    files = rooted(unzipped(spark.read.format("binaryFile").load(path)))
    return files.where(wanted(F.col("path"), F.col("size"))).select("path", "content", "size")


def read_source(spark: SparkSession, source: str) -> DataFrame:
    """Files of a zip archive or a directory; a web address has to be fetched first."""
    if source.startswith(("http://", "https://")):
        raise ValueError("fetch the archive first: see functions.scalar.archive_url")
    return read_zip(spark, source) if source.lower().endswith(".zip") else read_directory(spark, source)


def decoded(files: DataFrame, no_zero_bytes: bool = False) -> DataFrame:
    """path, text, size of text files: UTF-8 or else Latin-1; binary extensions and blank texts are left out."""
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    rows = files.where(~S.is_binary_file(F.col("path")))
    if no_zero_bytes:
        rows = rows.where(F.position(F.lit(b"\0"), F.col("content")) == 0)
    return rows.select("path", text.alias("text"), "size").where(F.col("text").rlike(r"\S"))


def tree(files: DataFrame) -> DataFrame:
    """path, parent_path, name, type, size, depth of all files (path, size) and the directories above them; hidden ones are left out."""
    shown = files.where(~F.exists(F.split("path", "/"), lambda p: p.startswith(".")))
    parts = shown.select(F.split("path", "/").alias("p"), "size")
    each = parts.select("p", "size", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"))
    file = F.col("depth") == F.size("p")
    rows = each.select(
        F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("path"), F.array_join(F.slice("p", F.lit(1), F.col("depth") - 1), "/").alias("parent_path"), F.get("p", F.col("depth") - 1).alias("name"),
        F.when(file, "file").otherwise("directory").alias("type"), F.when(file, F.col("size")).alias("size"), "depth",
    )
    return rows.distinct()


def write_ingest(df: DataFrame, folder: str) -> str:
    """The rows as JSON lines in a folder, one file per partition, nulls left out: the sink of an ingest run."""
    df.write.mode("overwrite").json(folder)
    return folder


def read_ingest(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of an ingest run; an error that names the folder where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(f"no ingest output in {folder}")
    return spark.read.schema(schema).json(folder)


def tree_order() -> list[Column]:
    return [F.col("parent_path"), F.col("type") == "file", F.col("name")]


def read_embeddings(spark: SparkSession, path: str, dims: int, rows: int | None = None) -> DataFrame:
    """chunk_seq, embedding of a float32 little-endian row-major file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                if len(content) % (4 * dims) or (rows is not None and len(content) != 4 * dims * rows):
                    raise ValueError(f"{len(content)} bytes are not rows of {dims} floats")
                x = np.frombuffer(content, "<f4").reshape(-1, dims)
                for at in range(0, len(x), 8192):
                    part = x[at : at + 8192]
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), dims).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), flat], names=["chunk_seq", "embedding"])

    return spark.read.format("binaryFile").load(path).mapInArrow(run, "chunk_seq long, embedding array<float>")


def write_embeddings(vectors: DataFrame, path: str) -> dict:
    """Write float32 rows in the order of chunk_seq to a local file, a partition at a time; returns shape and bytes."""
    n, dims = 0, None
    with open(path, "wb") as f:
        for row in vectors.select("chunk_seq", "embedding").orderBy("chunk_seq").toLocalIterator():
            if dims not in (None, len(row[1])):
                raise ValueError("rows differ in length")
            dims = len(row[1])
            f.write(np.array(row[1], "<f4").tobytes())
            n += 1
    return {"rows": n, "dims": dims or 0, "bytes": 4 * n * (dims or 0)}


def write_embedding_parts(vectors: DataFrame, folder: str) -> None:
    """Float32 rows in the order of chunk_seq as a table (part, at, n, content) in a folder that the cluster shares, each range by its own task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            content = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([at]), pa.array([batch.num_rows]), pa.array([content], pa.binary())], names=["part", "at", "n", "content"])
            at += batch.num_rows

    rows = vectors.select("chunk_seq", F.col("embedding").cast("array<float>")).repartitionByRange("chunk_seq").sortWithinPartitions("chunk_seq")
    rows.select("embedding").mapInArrow(run, "part long, at long, n long, content binary").write.mode("overwrite").parquet(folder)


def read_embedding_parts(spark: SparkSession, folder: str, dims: int) -> DataFrame:
    """chunk_seq (the place over all parts), embedding of such a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(content, "<f4")
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x), dims).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(flat))), flat], names=["chunk_seq", "embedding"])

    parts = spark.read.parquet(folder)
    # As many rows as there are parts.
    whole = parts.groupBy("part").agg(F.sum("n").alias("s"))
    base = whole.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return parts.join(F.broadcast(base), "part").select((F.col("base") + F.col("at")).alias("first"), "content").mapInArrow(run, "chunk_seq long, embedding array<float>")
