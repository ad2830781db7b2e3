"""Knowledge packs: seven members in one zip, as a sink and as a source, and Parquet for what is too large for one."""

from __future__ import annotations

import json
import tempfile
import zipfile
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batching import numbered_batches  # noqa: F401  re-exported for writers that page through chunks
from .files import write_embeddings

VERSION = "6.1.0"
#: The members, in their order.
MEMBERS = ("manifest.json", "filestructure.json", "chunks.json", "embeddings.bin", "graph.json", "documentation.json", "README.md")


def manifest(files: DataFrame, chunks: DataFrame, source: dict, domain: str, ingestor: str, dims: int, embedder: str, statistics: DataFrame | None = None, threshold: float = 0.65) -> dict:
    """Counts and how the pack was made. total_files counts the files loaded, chunked_files those with a chunk."""
    out = {
        "docpack_version": VERSION, "source": source, "domain": domain, "ingestor": ingestor, "generated_at": datetime.now(timezone.utc).isoformat(), "total_files": files.count(),
        "chunked_files": chunks.select("path").distinct().count(), "total_chunks": chunks.count(), "embedding_dimensions": dims, "chunk_schema_version": "1.0",
        "generator": {"builder_version": VERSION, "embedder": embedder, "gpu_used": False},
    }
    if statistics is not None:
        s = statistics.first()
        short = {"worthy": s["n_worthy"], "percent": round(s["percent_worthy"] or 0.0, 2), "mean": round(s["mean"] or 0.0, 4), "median": round(s["median"] or 0.0, 4)}
        out["doc_scoring"] = {"enabled": True, "threshold": threshold, "statistics": short}
    return out


def source_manifest(repo: str, branch: str, n_files: int, n_chunks: int, dims: int) -> dict:
    """The older manifest, for packs built of a repository alone."""
    return {"docpack_version": "6.0.0", "source_repo": repo, "branch": branch, "generated_at": datetime.now(timezone.utc).isoformat(), "total_files": n_files, "total_chunks": n_chunks, "embedding_dimensions": dims, "generator": {"builder_version": "6.0.0"}}


def readme(m: dict) -> str:
    day = m["generated_at"][:10]
    return f"# Knowledge pack\n\nDomain: {m.get('domain', 'code')}\nFiles: {m['total_files']}\nChunks: {m['total_chunks']}\nDimensions: {m['embedding_dimensions']}\nMade on {day}\n"


def nested_tree(rows: list[dict]) -> dict:
    """The tree as one object, directories before files, by name."""
    top: dict = {"name": "", "type": "directory", "children": []}
    at = {"": top}
    for r in sorted(rows, key=lambda r: (r["depth"], r["parent_path"], r["type"] == "file", r["name"])):
        node = {"name": r["name"], "type": r["type"]} | ({"size": r["size"]} if r["type"] == "file" else {"children": []})
        at[r["parent_path"]]["children"].append(node)
        if r["type"] == "directory":
            at[r["path"]] = node
    return top


def write_json(value: object, path: str, pretty: bool = True) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2 if pretty else None, ensure_ascii=False), encoding="utf-8")


def json_rows(df: DataFrame) -> list[dict]:
    """Rows without nulls, brought over a partition at a time."""
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns))).toLocalIterator()]


def write_pack(path: str, m: dict, tree: DataFrame, chunks: DataFrame, embeddings: DataFrame, nodes: DataFrame, edges: DataFrame, docs: DataFrame) -> str:
    """One zip with all members; a driver-side export, for packs that fit one file."""
    with tempfile.TemporaryDirectory() as d, zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        write_embeddings(embeddings, f"{d}/e")
        body = {
            "manifest.json": m, "filestructure.json": nested_tree([r.asDict() for r in tree.toLocalIterator()]), "chunks.json": json_rows(chunks.orderBy("chunk_seq")),
            "graph.json": {"nodes": json_rows(nodes), "edges": json_rows(edges)}, "documentation.json": {"summaries": json_rows(docs)},
        }
        for name in MEMBERS:
            if name == "embeddings.bin":
                z.write(f"{d}/e", name)
            else:
                z.writestr(name, readme(m) if name == "README.md" else json.dumps(body[name], indent=2, ensure_ascii=False))
    return path


def write_tables(folder: str, **tables: DataFrame) -> None:
    """The same as Parquet, one folder per table, for any size."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def pack_info(path: str) -> dict:
    """Manifest, and the members with their sizes."""
    with zipfile.ZipFile(path) as z:
        return {"manifest": json.loads(z.read("manifest.json")), "members": {i.filename: i.file_size for i in z.infolist()}}


def extract_pack(path: str, folder: str) -> list[str]:
    with zipfile.ZipFile(path) as z:
        z.extractall(folder)
        return z.namelist()


def read_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """chunks.json of an extracted pack or of an ingest run."""
    return spark.read.schema(schema).json(path, multiLine=True)
