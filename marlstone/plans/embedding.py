"""Embedding models behind one protocol; a hashing one needs no files and gives the same vectors everywhere."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.fixed import EMBEDDING_DIMS

_made: dict[str, Callable[[list[str]], np.ndarray]] = {}


def hashing_model(dims: int) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors of signed counts of hashed words; a text without words has the zero vector."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for k, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                out[k, h % dims] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


def resolved(model: str | None = None, preset: str | None = None, default: str | None = None) -> str:
    """The preset if it is known, else the model (by name or preset), else the default, else the fast preset."""
    if preset in EMBEDDING_DIMS:
        return preset
    return model or default or "fast"


def dimensions(preset: str) -> int:
    return EMBEDDING_DIMS[preset]


def embedded(chunks: DataFrame, name: str = "hash-384", make: Callable[[], Callable[[list[str]], np.ndarray]] | None = None, batch: int = 32) -> DataFrame:
    """chunk_seq, embedding of chunks (chunk_seq, text); `make` loads the model once in each worker."""
    dims = int(name.rsplit("-", 1)[1]) if name.startswith("hash-") else 0
    load = make or (lambda: hashing_model(dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _made.setdefault(name, None) or _made.update({name: load()}) or _made[name]
        for whole in batches:
            texts = whole.column(1).to_pylist()
            x = np.concatenate([model(texts[k : k + batch]) for k in range(0, len(texts), batch)]) if texts else np.zeros((0, 1), np.float32)
            yield pa.RecordBatch.from_arrays([whole.column(0), pa.array(list(x), pa.list_(pa.float32()))], names=["chunk_seq", "embedding"])

    return chunks.select("chunk_seq", "text").mapInArrow(run, "chunk_seq long, embedding array<float>")
