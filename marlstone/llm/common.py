"""What the operators of this subpackage share: reading tables, shared scratch tables, packed document batches."""

from __future__ import annotations

import atexit
import ctypes
import functools
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one packed batch holds at most, unless a single text is longer.
BATCH_BYTES = 4 << 20
#: Bytes of text for which one bucket of hashes is set aside.
BUCKET_BYTES = 8 << 20

#: A-Z to a-z, all else as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only where none is configured, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def settle(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back: this cuts the lineage and survives lost executors.

    The table goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/marlstone-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._marlstone_path = path
    return out


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session is over already
        return


def drop_settled(df: DataFrame) -> None:
    """Remove a settled table that nothing will read again."""
    remove(df.sparkSession, df._marlstone_path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffle files of plans that are done, and give back the driver's freed memory; a hint, results never depend on it."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
    trim_jvm(spark)
    give_back()


def trim_jvm(spark: SparkSession) -> bool:
    """Return what the driver's JVM has freed outside its heap to the system: many short-lived threads leave much behind. Whether that JVM can."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        # By the interface: the server's own class is not open to calls.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Exception:  # noqa: BLE001  an older JVM, or another kind
        return False
    return True


def encoded(text: str | None) -> bytes:
    """UTF-8; a lone surrogate, which Spark itself never yields, becomes '?'."""
    return b"" if text is None else text.encode("utf-8", "replace")


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def give_back() -> None:
    """Return what this Python has freed to the system; workers outlive their tasks, and several stand beside one JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc
        trim(0)


def lean(f: Callable, tokens: bool = False) -> Callable:
    """f for mapInArrow, which gives back memory at a task's end; the tokenizers of earlier tasks go first, unless it needs them."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sys.modules.get(f"{__package__}.tokens")
        if held is not None and not tokens:
            held.forget_all()
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def pack_documents(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Batches of documents, one row each: m, n_bytes, ids, lengths, blob (the texts' UTF-8 bytes, zstd).

    Later steps join what they learned about batch m back to it by m, so texts move as a few compressed rows.
    ids and lengths are int64 arrays in binary; a null doc_id is kept as the smallest int64.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pa.RecordBatch.from_pydict(
                {
                    "m": pa.array([(part << 32) | k], pa.int64()),
                    "n_bytes": pa.array([size], pa.int64()),
                    "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                    "lengths": pa.array([np.array([len(t) for t in texts], np.int64).tobytes()], pa.binary()),
                    "blob": pa.array([blob], pa.binary()),
                }
            )

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = encoded(text)
                if texts and size + len(b) > batch_bytes:
                    yield row()
                    k, ids, texts, size = k + 1, [], [], 0
                ids.append(-(1 << 63) if i is None else i)
                texts.append(b)
                size += len(b)
        if texts:
            yield row()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(pack), "m long, n_bytes long, ids binary, lengths binary, blob binary")


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
    """ids, lengths and the bytes of a packed row."""
    import zstandard

    blob = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=max(1, row["n_bytes"])) if row["n_bytes"] else b""
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int64), blob


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as dicts, one at a time, so that one large row after the other is held."""
    for batch in batches:
        names = batch.schema.names
        for k in range(batch.num_rows):
            yield {n: batch.column(j)[k].as_py() for j, n in enumerate(names)}


def ids_array(ids: np.ndarray) -> pa.Array:
    """int64 ids, the stand-in for null as null."""
    return pa.array(ids, pa.int64(), mask=ids == np.iinfo(np.int64).min)
