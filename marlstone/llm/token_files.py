"""Token files: the ids of all documents in ascending doc_id order, in segments of coded blocks with a document index.

Documents are dealt by ranges of doc_id, as many as their bytes need. Each range writes segments of whole documents; a segment has its coded blocks and, for
each document, its id and number of ids. Segments are written to a table in the shared folder (part, start, index, blocks),
sorted within each part, and read back from it; `part` orders the ranges, `start` is the number of ids before it in the part.
Spark's JVMs code and decode the blocks (IdCodec.java); `segment_ids` reads them in Python, for those who train.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import settle
from .idcodec import decode
from .jvm import register
from .tokens import slices_by_size, tokenizer, with_end

#: Ids, and documents, after which a segment ends, at the end of a slice of whole documents; a longer document is one segment.
SEGMENT, DOCUMENTS = 2 << 20, 1 << 16
#: Blocks decoded side by side in Python at most. A step costs much the same for few of them, so they are dealt evenly.
LANES = 1024
#: Bytes of text for which one range of doc_ids is set aside: most often 4 to 5 million ids.
RANGE_BYTES = 16 << 20
SCHEMA = "part long, start long, index binary, ids binary"
_BLOCKS = ArrayType(BinaryType())
_DOCUMENTS = ArrayType(StructType([StructField(name, LongType()) for name in ("doc_id", "start", "n_tokens", "ids_crc32")]))


def lane_slices(n: int) -> list[slice]:
    """As few slices of n blocks as LANES allows, of equal sizes but for one block."""
    runs = -(-n // LANES)
    cuts = [n * k // runs for k in range(runs + 1)] if runs else []
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def segment_ids(blocks: list[bytes]) -> np.ndarray:
    """All ids of a segment, read without Spark; a damaged block raises ValueError."""
    return np.concatenate([np.zeros(0, np.uint32), *(x for at in lane_slices(len(blocks)) for x in decode(blocks[at]))])


def write_token_files(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """The table of segments. Null texts are the end id alone; null doc_ids come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cut, part, start, size = tokenizer(path), TaskContext.get().partitionId(), 0, 0
        names: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def segment() -> pa.RecordBatch:
            index = np.stack([np.concatenate(names), np.concatenate(counts)]).astype("<i8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([start]), pa.array([index]), pa.array([np.concatenate(held).tobytes()])], names=["part", "start", "index", "ids"])

        for batch in batches:
            own, texts = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for at in slices_by_size(texts):
                ids, many = with_end(*cut(texts[at]), end_id)
                if ids.max() >= 1 << 16:
                    raise ValueError("an id needs more than 16 bits")
                if held and (size + len(ids) > SEGMENT or sum(map(len, names)) + len(many) > DOCUMENTS):
                    yield segment()
                    start += size
                    names, counts, held, size = [], [], [], 0
                names.append(own[at])
                counts.append(many)
                held.append(ids.astype("<u2"))
                size += len(ids)
        if held:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = max(1, -(-(rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // RANGE_BYTES))
    segments = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, SCHEMA)
    blocks = register(docs.sparkSession, "IdCodec.java", "marlstone.IdCodec$Blocks", "marlstone_blocks", _BLOCKS)
    return settle(segments.select("part", "start", "index", F.call_function(blocks, "ids").alias("blocks")), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, part, start (within the part), n_tokens, ids_crc32 from the segments; a damaged block ends the job in an error."""
    documents = register(files.sparkSession, "IdCodec.java", "marlstone.IdCodec$Documents", "marlstone_documents", _DOCUMENTS)
    read = files.select("part", "start", F.explode(F.call_function(documents, "index", "blocks")).alias("d"))
    return read.select("d.doc_id", "part", (F.col("start") + F.col("d.start")).alias("start"), "d.n_tokens", "d.ids_crc32")


def token_file_index(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Write the token files, read them back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    An empty table gives no rows. Rows with the same doc_id stand one after the other in any order. Other columns are not read.
    """
    read = settle(read_token_files(write_token_files(docs, path, end_id)), "token-index")
    # One row for each range of doc_ids, as many as there are shuffle partitions.
    totals = sorted(read.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in totals)]).tolist()
    bases = read.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(totals, before, strict=False)], "part long, base long")
    return read.join(F.broadcast(bases), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
