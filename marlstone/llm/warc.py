"""WARC files of pages, and a Merkle audit of their fixity between replicas.

Each file's records are the leaves of a tree: a leaf hashes a record and its offset range, a node its children's hashes and the
range they cover. A replica's root hashes all files' roots, level by level. An audit compares the roots; only where they differ
does it compare the files' trees, from the top, each level only below nodes that differ, down to the damaged records.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, settle

#: Pages of consecutive ids in a file.
FILE_PAGES = 256
FANOUT = 16
#: Levels above the leaves. A file of more than FANOUT ** DEPTH records has more than one node at the top, which is as good.
DEPTH = 3
DATE = "2000-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_ID = re.compile(rb"\r\nWARC-Record-ID: <urn:marlstone:page:(-?\d+|none)>\r\n", re.I)


def record(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> bytes:
    """One resource record; a null url or html is empty. Control characters of the url, line ends too, are percent-encoded."""
    url = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    body = (html or "").encode("utf-8", "replace")
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:marlstone:page:{'none' if page_id is None else page_id}>\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n"
    head += f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode("utf-8", "replace") + body + b"\r\n\r\n"


def ranges(content: bytes, ends: list[int]) -> Iterator[tuple[int, int]]:
    """Start and stop of each record, and of what stands behind the last one."""
    at = 0
    for stop in [*ends, *([len(content)] if len(content) > (ends[-1] if ends else 0) else [])]:
        yield at, stop
        at = stop


def write_warc(pages: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """file, content, ends: WARC files of the pages in order of page_id, file_pages consecutive ids each, and where their records end.

    Rows with a null page_id go to negative files by a hash; repeated rows give repeated records; an empty table no files.
    Other columns are not read.
    """

    def build(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        parts = [record(*r) for r in rows]
        ends = list(accumulate(map(len, parts)))
        return pa.table({"file": t.column("file").slice(0, 1), "content": pa.array([b"".join(parts)], pa.binary()), "ends": pa.array([ends], pa.list_(pa.int64()))})

    file = F.when(F.col("page_id").isNotNull(), F.floor(F.col("page_id") / file_pages)).otherwise(-1 - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 40)))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("file", file)
    return settle(rows.groupBy("file").applyInArrow(build, "file long, content binary, ends array<long>"), "warc", "zstd")


_NODES = "file long, level int, idx long, start long, stop long, hash string, digest string, page_id long"


def merkle_nodes(files: DataFrame) -> DataFrame:
    """All nodes of the files' trees: level 0 are records, with digest (of the bytes alone) and page_id.

    Records are cut by the index that the writer kept, so damaged bytes never hide where the next one begins. Bytes behind the
    last one, as a longer replica has, are a record of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            out: list[tuple] = []
            level: list[tuple] = []
            for k, (at, stop) in enumerate(ranges(row["content"], row["ends"])):
                raw = row["content"][at:stop]
                digest, name = hashlib.sha256(raw).hexdigest(), _ID.search(raw)
                number = int(name[1]) if name and name[1] != b"none" else None
                level.append((row["file"], 0, k, at, stop, hashlib.sha256(f"{at}-{stop}:{digest}".encode()).hexdigest(), digest, number))
            out += level
            for depth in range(1, DEPTH + 1):
                above = []
                for k in range(0, len(level), FANOUT):
                    own = level[k : k + FANOUT]
                    text = f"{own[0][3]}-{own[-1][4]}:" + "".join(x[5] for x in own)
                    above.append((row["file"], depth, k // FANOUT, own[0][3], own[-1][4], hashlib.sha256(text.encode()).hexdigest(), None, None))
                out += above
                level = above
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["file", "level", "idx", "start", "stop", "hash", "digest", "page_id"])

    return files.select("file", "content", "ends").mapInArrow(run, _NODES)


def replica_root(nodes: DataFrame, width: int = 4096) -> str:
    """The hash over all files' top nodes, in levels of at most `width` children."""
    level = nodes.where(F.col("level") == DEPTH).select(F.col("file").alias("at"), F.col("idx").alias("sub"), "hash")
    while True:
        packed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sub", "hash"))), lambda x: F.concat_ws(":", x["at"], x["sub"], x["hash"])), ",")
        level = level.groupBy(F.floor(F.col("at") / width).alias("at")).agg(F.sha2(packed, 256).alias("hash")).withColumn("sub", F.lit(0).cast("long"))
        got = level.select("at", "hash").limit(2).collect()
        if len(got) <= 1 or {r[0] for r in got} <= {-1, 0}:
            rows = sorted(map(tuple, level.select("at", "hash").where("at IN (-1, 0)").collect()))
            if level.where("at NOT IN (-1, 0)").isEmpty():
                return hashlib.sha256(",".join(f"{a}:{h}" for a, h in rows).encode()).hexdigest()


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """file, idx, damage of each record in which the node tables of two replicas differ.

    damage: changed (other bytes), moved (same bytes, other offsets), missing (not in theirs), extra (not in ours).
    """
    spark = ours.sparkSession
    if replica_root(ours) == replica_root(theirs):
        return spark.createDataFrame([], "file long, idx long, damage string")
    bad: DataFrame | None = None
    for level in range(DEPTH, -1, -1):
        a = ours.where(F.col("level") == level).select("file", "idx", F.col("hash").alias("h1"), F.col("digest").alias("d1"))
        b = theirs.where(F.col("level") == level).select("file", "idx", F.col("hash").alias("h2"), F.col("digest").alias("d2"))
        if bad is not None:
            parent = bad.select("file", F.col("idx").alias("up"))
            a, b = (x.withColumn("up", F.floor(F.col("idx") / FANOUT)).join(parent, ["file", "up"], "left_semi").drop("up") for x in (a, b))
        bad = a.join(b, ["file", "idx"], "full_outer").where(~F.col("h1").eqNullSafe(F.col("h2")))
    damage = F.when(F.col("h1").isNull(), "extra").when(F.col("h2").isNull(), "missing").when(F.col("d1") == F.col("d2"), "moved").otherwise("changed")
    return bad.select("file", "idx", damage.alias("damage"))


def damaged_copy(files: DataFrame, hurts: Callable[[int | None], bool]) -> DataFrame:
    """A replica in which a byte of some records (by page_id) is flipped, the body's last or else one of the date; for drills."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            content = bytearray(row["content"])
            for at, stop in ranges(row["content"], row["ends"]):
                name = _ID.search(row["content"], at, stop)
                if name and name[1] != b"none" and hurts(int(name[1])):
                    body = row["content"].find(b"\r\n\r\n", at) + 4
                    content[stop - 5 if stop - 4 > body else row["content"].find(b"\r\nWARC-Date: ", at) + 13] ^= 1
            yield pa.RecordBatch.from_arrays([pa.array([row["file"]], pa.int64()), pa.array([bytes(content)], pa.binary()), pa.array([row["ends"]], pa.list_(pa.int64()))], names=["file", "content", "ends"])

    return files.select("file", "content", "ends").mapInArrow(run, "file long, content binary, ends array<long>")


def fixity_drill(pages: DataFrame, every: int = 50, which: int = 7) -> DataFrame:
    """Write WARC files, damage a copy where page_id % every == which, audit: page_id, file, start, stop, digest, damage per record."""
    files = write_warc(pages)
    ours = settle(merkle_nodes(files), "nodes")
    theirs = settle(merkle_nodes(damaged_copy(files, lambda i: i % every == which)), "nodes")
    found = audit(ours, theirs)
    return ours.where("level = 0").join(found, ["file", "idx"], "left").select("page_id", "file", "start", "stop", "digest", F.coalesce("damage", F.lit("none")).alias("damage"))


ORACLE = """
WITH p AS (SELECT page_id, CAST(floor(page_id / 256) AS BIGINT) AS file, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, file, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:marlstone:page:' || page_id || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Date: 2000-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Block-Digest: sha256:' || sha256(html) || chr(13) || chr(10)
  || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM p),
o AS (SELECT page_id, file, sha256(rec) AS digest, sum(strlen(rec)) OVER (PARTITION BY file ORDER BY page_id) AS stop, strlen(rec) AS n FROM r)
SELECT page_id, file, CAST(stop - n AS BIGINT) AS "start", CAST(stop AS BIGINT) AS stop, digest, CASE WHEN page_id % 50 = 7 THEN 'changed' ELSE 'none' END AS damage FROM o
"""
