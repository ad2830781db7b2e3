"""From files to chunks: fixed windows in DataFrame functions, sequential packers as Arrow generators."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .order import sums_before

PARTS = "path string, seq int, kind string, text string, start int, stop int, heading string, heading_level int, line_start int, line_end int"


def fixed_windows(files: DataFrame, size: int = 240) -> DataFrame:
    """path, seq, start, stop, text: consecutive windows of `size` characters of each file's text; blank files give none."""
    n = F.length("text")
    starts = F.sequence(F.lit(0), n - 1, F.lit(size))
    rows = files.where(F.col("text").rlike(r"\S")).select("path", "text", F.posexplode(starts).alias("seq", "start"))
    stop = F.least(F.col("start") + size, n)
    return rows.select("path", "seq", "start", stop.alias("stop"), F.substring("text", F.col("start") + 1, F.lit(size)).alias("text"))


def numbered(chunks: DataFrame) -> DataFrame:
    """chunks with chunk_seq, their place by (path, start) over all files: counts per path, summed over the paths before."""
    per_path = chunks.groupBy("path").agg(F.count("*").alias("n"))
    own = F.row_number().over(Window.partitionBy("path").orderBy("start")) - 1
    return chunks.withColumn("own", own).join(sums_before(per_path, "path", "n"), "path").withColumn("chunk_seq", F.col("before") + F.col("own")).drop("own", "before")


def sentences(text: str) -> list[str]:
    return re.split(r"(?<=[.!?])\s+", text)


def runs(parts: list[str], size: int, gap: int, light: bool = False) -> Iterator[tuple[int, int]]:
    """(a, b) of consecutive parts whose lengths, each with a gap, add up to `size` at most; a part that is too long stands alone.

    With light, a part that found no room in the run before it counts without its gap.
    """
    a = n = 0
    for k, part in enumerate(parts):
        if k > a and n + len(part) + gap > size:
            yield a, k
            a, n = k, -gap if light and len(parts[k - 1]) <= size else 0
        n += len(part) + gap
    if parts:
        yield a, len(parts)


def long_text(text: str, size: int) -> list[str]:
    """Pieces of at most `size` characters by sentences, or by words where a sentence is longer; one long word stays whole."""
    out: list[str] = []
    found = sentences(text)
    for a, b in runs(found, size, 1):
        if len(found[a]) > size:
            words = found[a].split()
            out += [" ".join(words[x:y]) for x, y in runs(words, size, 1)]
        else:
            out.append(" ".join(found[a:b]))
    return [p for p in out if p]


def paragraphs(text: str, size: int, least: int) -> list[tuple[str, int, int]]:
    """(text, start, stop) of packed paragraphs; places count what was packed. A last piece below `least` goes."""
    found = [p for p in (x.strip() for x in re.split(r"\n\s*\n", text)) if p]
    pieces: list[tuple[str, int]] = []  # with the gap behind it
    for a, b in runs(found, size, 2, light=True):
        if len(found[a]) > size:
            pieces += [(piece, 0) for piece in long_text(found[a], size)]
        elif b < len(found) or len("\n\n".join(found[a:b])) >= least:
            pieces.append(("\n\n".join(found[a:b]), 2))
    starts = accumulate((len(t) + gap for t, gap in pieces), initial=0)
    return [(t, at, at + len(t)) for (t, _), at in zip(pieces, starts, strict=False)]


def sections(text: str, size: int, least: int) -> list[tuple[str, int, int, str | None, int]]:
    """(text, start, stop, heading line, level) of markdown sections of at least `least` characters.

    What stands before the first heading, or a text without headings, is a section of level 1 without a heading. A heading
    directly before another one is left out. A body longer than `size` is cut and its pieces stand apart within the section.
    """
    marks = list(re.finditer(r"^#{1,6}\s+.+$", text, re.M))
    edges = [0, *(m.end() for m in marks)], [*(m.start() for m in marks), len(text)]
    heads = [None, *(m[0].strip() for m in marks)]
    out, at = [], 0
    for k, (head, lo, hi) in enumerate(zip(heads, *edges, strict=True)):
        body = text[lo:hi].strip()
        if not body and (head is None or k < len(marks)):
            continue
        parts = long_text(body, size) if len(body) > size else [body] * bool(body)
        whole = "\n\n".join([*([head] if head else []), *parts])
        if len(whole) >= least:
            level = len(head) - len(head.lstrip("#")) if head else 1
            out.append((whole, at, at + len(whole), head, level))
            at += len(whole) + 2
    return out


def packed_lines(text: str, size: int, least: int) -> list[tuple[str, int, int, int, int]]:
    """(text, start, stop, first line, last line) of packed lines; a last piece below `least` goes."""
    lines = text.split("\n")
    out, at = [], 0
    for a, b in runs(lines, size, 1):
        whole = "\n".join(lines[a:b])
        if b < len(lines) or len(whole) >= least:
            out.append((whole, at, at + len(whole), a + 1, b))
        at += len(whole) + 1
    return out


def split_file(path: str, text: str, size: int, least: int) -> list[tuple]:
    """Rows of PARTS after path and seq, by the file's extension."""
    ext = path[path.rfind(".") :].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ext in (".md", ".markdown"):
        found = sections(text, size, least)
        if found:
            return [("section", t, a, b, h, level, None, None) for t, a, b, h, level in found]
    if ext in (".json", ".yaml", ".yml", ".toml"):
        if len(text) <= 2 * size:
            return [("config", text, 0, len(text), None, None, 1, text.count("\n") + 1)]
        return [("text", t, a, b, None, None, x, y) for t, a, b, x, y in packed_lines(text, size, least)]
    return [("paragraph", t, a, b, None, None, None, None) for t, a, b in paragraphs(text, size, least)]


def text_chunks(files: DataFrame, size: int = 500, least: int = 100) -> DataFrame:
    """PARTS of each file (path, text), by sections, lines or paragraphs; null and blank files give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(path, k, *r) for k, r in enumerate(split_file(path, text, size, least))]
                if rows:
                    cols = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in PARTS.split(", ")])

    return files.where(F.col("text").rlike(r"\S") & F.col("path").isNotNull()).select("path", "text").mapInArrow(run, PARTS)


def long_text_chunks(files: DataFrame, size: int = 500) -> DataFrame:
    """path, seq, text: the pieces of long_text of each file (path, text); null and blank files give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = long_text(text, size)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=["path", "seq", "text"])

    return files.where(F.col("text").rlike(r"\S") & F.col("path").isNotNull()).select("path", "text").mapInArrow(run, "path string, seq int, text string")


def chunk_records(parts: DataFrame, domain: str = "generic") -> DataFrame:
    """Chunks of text parts: chunk_id, domain, path, type, text, start, stop, language, depth, line_start, line_end, extra."""
    heading = F.when(F.col("heading").isNotNull(), F.create_map(F.lit("heading"), F.col("heading")))
    return parts.select(
        S.chunk_id(F.lit(domain), F.col("path"), F.col("start")).alias("chunk_id"),
        F.lit(domain).alias("domain"),
        "path",
        S.element_type(F.col("kind")).alias("type"),
        "text",
        "start",
        "stop",
        S.text_format(F.col("path")).alias("language"),
        F.coalesce("heading_level", F.lit(0)).alias("depth"),
        "line_start",
        "line_end",
        heading.alias("extra"),
    )


_RECORD = "chunk_id string, domain string, path string, file_path string, type string, text string, start int, `end` int, metadata struct<language:string,line_start:int,line_end:int,depth:int,semantic_role:string,visibility:string>"


def record_json(chunks: DataFrame) -> DataFrame:
    """chunk_id, json of chunks (chunk_id, domain, path, type, text, start, stop, language, depth, line_start, line_end); nulls are left out."""
    more = F.struct("language", "line_start", "line_end", "depth")
    return chunks.select("chunk_id", F.to_json(F.struct("chunk_id", "domain", "path", "type", "text", "start", F.col("stop").alias("end"), more.alias("metadata"))).alias("json"))


def records_of_json(rows: DataFrame) -> DataFrame:
    """Chunks of JSON records (json): file_path stands in for path; domain, type, places and depth have defaults; an id and a text must be there."""
    r = rows.select(F.from_json("json", _RECORD).alias("r")).where("r.chunk_id IS NOT NULL AND r.text IS NOT NULL")
    other = lambda c, d: F.coalesce(F.col(f"r.{c}"), F.lit(d))
    return r.select(
        "r.chunk_id", other("domain", "generic").alias("domain"), F.coalesce("r.path", "r.file_path", F.lit("")).alias("path"), other("type", "text").alias("type"), "r.text", other("start", 0).alias("start"), other("end", 0).alias("stop"),
        "r.metadata.language", other("metadata.depth", 0).alias("depth"), "r.metadata.line_start", "r.metadata.line_end",
    )


def ids_per_path(chunks: DataFrame) -> DataFrame:
    """path, domain, first, chunk_ids of chunks (chunk_seq, chunk_id, path, domain): ids in order, the domain of the first one."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_seq", "chunk_id", "domain")))
    return chunks.groupBy("path").agg(rows.alias("r")).select("path", F.get("r", F.lit(0))["domain"].alias("domain"), F.get("r", F.lit(0))["chunk_seq"].alias("first"), F.transform("r", lambda x: x["chunk_id"]).alias("chunk_ids"))
