"""Ingestors: which kind of source a set of files is, and how it is chunked."""

from __future__ import annotations

import warnings
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import chunkers
from ..operators import symbols as symbol_ops
from ..operators.order import sums_before
from ..sources.files import decoded


class Ingestor(Protocol):
    name: str
    domain: str
    priority: int

    def detect(self) -> Column:
        """An aggregate over files (path) that tells whether they are of this kind."""

    def chunks(self, files: DataFrame) -> DataFrame:
        """chunk_id, path, type, text, start, stop and more, of files (path, content, size)."""


class CodeIngestor:
    name, domain, priority = "code", "code", 100

    def __init__(self, size: int = 240) -> None:
        self.size = size

    def detect(self) -> Column:
        path = F.col("path")
        return F.coalesce(F.bool_or(S.is_marker(path)) | (F.avg(S.is_code_file(path).cast("double")) > 0.3), F.lit(False))

    def chunks(self, files: DataFrame) -> DataFrame:
        rows = symbol_ops.chunk_files(decoded(files), self.size)
        return rows.withColumns({"domain": F.lit("code"), "language": S.language(F.col("path")), "depth": F.lit(0), "role": F.coalesce("metadata.semantic_role", S.infer_role(F.col("text"))), "line_start": F.when(F.col("symbol_name").isNotNull(), F.col("start")), "line_end": F.when(F.col("symbol_name").isNotNull(), F.col("stop"))})


class TextIngestor:
    name, domain, priority = "generic_text", "generic", 0

    def __init__(self, size: int = 500, least: int = 100) -> None:
        self.size, self.least = size, least

    def detect(self) -> Column:
        return F.coalesce(F.bool_or(~S.is_binary_file(F.col("path"))), F.lit(False))

    def chunks(self, files: DataFrame) -> DataFrame:
        rows = chunkers.chunk_records(chunkers.text_chunks(decoded(files), self.size, self.least))
        return rows.withColumns({"symbol_name": F.lit(None).cast("string"), "visibility": F.lit(None).cast("string"), "role": F.lit(None).cast("string"), "metadata": F.lit(None).cast("string")}).drop("extra")


class Registry:
    """Ingestors by name; the one of highest priority that detects its kind is selected."""

    def __init__(self) -> None:
        self.known: dict[str, Ingestor] = {}
        self.fallback: str | None = None

    def register(self, ingestor: Ingestor | type, fallback: bool = False) -> None:
        made = ingestor() if isinstance(ingestor, type) else ingestor
        self.known[made.name] = made
        if fallback:
            self.fallback = made.name

    def unregister(self, name: str) -> None:
        self.known.pop(name, None)
        if self.fallback == name:
            self.fallback = None

    def get(self, name: str) -> Ingestor | None:
        return self.known.get(name)

    def names(self) -> list[str]:
        return [i.name for i in sorted(self.known.values(), key=lambda i: -i.priority)]

    def select(self, files: DataFrame, forced: str | None = None) -> Ingestor:
        """The forced one if known, else (with a warning) as without; one aggregate over the files answers all detectors at once.

        A detector that fails is left out: if the aggregate of all fails, each is tried on its own.
        """
        if forced in self.known:
            return self.known[forced]
        if forced is not None:
            warnings.warn(f"no ingestor is called {forced}; one is selected by the files", stacklevel=2)
        asked: dict[str, Column] = {}
        for name, i in self.known.items():
            try:
                asked[name] = i.detect().alias(name)
            except Exception as e:  # noqa: BLE001  a detector's own fault
                warnings.warn(f"the detector of {name} failed: {e}", stacklevel=2)
        found: dict[str, bool] = {}
        try:
            found = files.agg(*asked.values()).first().asDict() if asked else {}
        except Exception:  # noqa: BLE001  one of them fails when it runs
            for name, c in asked.items():
                try:
                    found[name] = files.agg(c).first()[0]
                except Exception as e:  # noqa: BLE001
                    warnings.warn(f"the detector of {name} failed: {e}", stacklevel=2)
        for name in self.names():
            if found.get(name):
                return self.known[name]
        if self.fallback:
            return self.known[self.fallback]
        raise ValueError("no ingestor for these files")

    def domain(self, files: DataFrame) -> str:
        return self.select(files).domain


def default_registry(code_size: int = 240, text_size: int = 500) -> Registry:
    r = Registry()
    r.register(CodeIngestor(code_size))
    r.register(TextIngestor(text_size), fallback=True)
    return r


def sequenced(chunks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """chunks with chunk_seq: their place by path and start, counted per path and summed over the paths before.

    The files (path), if given, tell how paths are dealt without making the chunks once more.
    """
    own = F.row_number().over(Window.partitionBy("path").orderBy("start", "stop", "chunk_id")) - 1
    per_path = chunks.groupBy("path").agg(F.count("*").alias("n"))
    return chunks.withColumn("own", own).join(sums_before(per_path, "path", "n", files), "path").withColumn("chunk_seq", (F.col("before") + F.col("own")).cast("long")).drop("own", "before")
