"""Writing documentation with a model behind one protocol, and the prompts for it; a deterministic stand-in for tests."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import batching

DOMAINS = ("code", "finance", "legal", "research", "generic")


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[dict]:
        """For each prompt: text (the answer), input_tokens, cached_tokens, output_tokens, success, error."""


class EchoGenerator:
    """Answers with the beginning of what it was asked; for tests and dry runs."""

    def generate(self, prompts: list[str]) -> list[dict]:
        return [{"text": json.dumps({"summary": p.strip().split("\n")[-1][:80]}), "input_tokens": len(p) // 4, "cached_tokens": 0, "output_tokens": 20, "success": True, "error": None} for p in prompts]


def templates(spark: SparkSession) -> DataFrame:
    """domain, prompt: one row each, with the places {symbol_info}, {context}, {text}."""
    focus = {"code": "what the code does, its parameters and its result", "finance": "the amounts, periods and metrics", "legal": "the parties, duties and terms", "research": "the question, method and findings", "generic": "the main points"}
    rows = [(d, f"Describe {focus[d]}. Answer in JSON.\n{{symbol_info}}\n{{context}}\n{{text}}") for d in DOMAINS]
    return spark.createDataFrame(rows, "domain string, prompt string")


def symbol_info(m: Column) -> Column:
    """Lines on a symbol's metadata (see operators.symbols.chunk_files), those without a value left out; empty without a name."""
    some = lambda c: c.isNotNull() & (c != "")
    line = lambda label, c: F.when(some(c), F.concat(F.lit(f"**{label}:** "), c))
    listed = F.transform(
        m["parameters"],
        lambda p: F.concat(F.lit("  - "), p["name"], F.when(some(p["type_annotation"]), F.concat(F.lit(": "), p["type_annotation"])).otherwise(""), F.when(some(p["default_value"]), F.concat(F.lit(" = "), p["default_value"])).otherwise("")),
    )
    has = F.coalesce(F.size(m["parameters"]) > 0, F.lit(False))
    signature = F.when(
        has | some(m["return_type"]),
        F.concat_ws("\n", F.lit("\n**Signature:**"), F.when(has, F.concat_ws("\n", F.lit("Parameters:"), F.array_join(listed, "\n"))), F.when(some(m["return_type"]), F.concat(F.lit("Returns: "), m["return_type"]))),
    )
    place = F.when((m["line_start"] > 0) & (m["line_end"] > 0), F.concat(F.lit("Lines "), m["line_start"].cast("string"), F.lit("-"), m["line_end"].cast("string")))
    doc = F.when(some(m["doc_comment"]), F.concat(F.lit("\n**Existing Doc Comment:**\n```\n"), m["doc_comment"], F.lit("\n```")))
    lines = F.concat_ws(
        "\n", F.lit("\n=== CODE SYMBOL METADATA ==="), line("Name", m["symbol_name"]), line("Qualified Name", m["qualified_name"]), line("Kind", m["symbol_kind"]), line("Visibility", m["visibility"]), line("Location", place), signature,
        line("Modifiers", F.array_join(m["modifiers"], ", ")), line("Parent", m["parent_name"]), doc, F.lit("=== END SYMBOL METADATA ===\n"),
    )
    return F.when(some(m["symbol_name"]), lines).otherwise("")


def prompts(chunks: DataFrame, context: DataFrame | None = None, max_tokens: int = 800) -> DataFrame:
    """chunk_seq, prompt of chunks (chunk_seq, domain, text, and symbol_info if there is one); unknown domains as generic."""
    rows = chunks.join(context.select(F.col("id").alias("chunk_seq"), "context"), "chunk_seq", "left") if context is not None else chunks.withColumn("context", F.lit(""))
    rows = rows.withColumn("domain", F.when(F.col("domain").isin(*DOMAINS), F.col("domain")).otherwise("generic"))
    info = F.col("symbol_info") if "symbol_info" in chunks.columns else F.lit("")
    rows = rows.join(F.broadcast(templates(chunks.sparkSession)), "domain")
    filled = F.replace(F.replace("prompt", F.lit("{symbol_info}"), F.coalesce(info, F.lit(""))), F.lit("{context}"), F.coalesce("context", F.lit("")))
    return rows.select("chunk_seq", F.replace(filled, F.lit("{text}"), S.truncated(F.col("text"), max_tokens)).alias("prompt"))


def generated(asked: DataFrame, generator: Generator, workers: int = 8, retry: bool = True) -> DataFrame:
    """chunk_seq, text, input_tokens, cached_tokens, output_tokens, success, error of prompts (chunk_seq, prompt).

    `workers` partitions ask at a time. What failed is asked once more with its prompt cut to three quarters; whole, where the
    marker would make it no shorter. A null prompt is not asked: no text, no tokens, success null.
    """
    schema = "chunk_seq long, text string, input_tokens long, cached_tokens long, output_tokens long, success boolean, error string"

    def shorter(prompt: str) -> str:
        cut = prompt[: len(prompt) * 3 // 4] + S.MARKER
        return cut if len(cut) < len(prompt) else prompt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            got = [{"text": None, "input_tokens": 0, "cached_tokens": 0, "output_tokens": 0, "success": None, "error": None} for _ in texts]
            asked_for = [k for k, t in enumerate(texts) if t is not None]
            for k, g in zip(asked_for, generator.generate([texts[k] for k in asked_for]), strict=True):
                got[k] = g
            again = [k for k in asked_for if not got[k]["success"]] if retry else []
            if again:
                for k, g in zip(again, generator.generate([shorter(texts[k]) for k in again]), strict=True):
                    got[k] = g
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            names = ("chunk_seq", "text", "input_tokens", "cached_tokens", "output_tokens", "success", "error")
            yield pa.RecordBatch.from_arrays([pa.array(keys if n == "chunk_seq" else [g[n] for g in got], t) for n, t in zip(names, kinds, strict=True)], names=list(names))

    return asked.repartition(workers).mapInArrow(run, schema)


def batched(chunks: DataFrame, generator: Generator, size: int = 15, workers: int = 8, max_tokens: int = 400) -> DataFrame:
    """symbol_id, answer, success, attempt of chunks (symbol_id, source, text): many symbols a request, validated, the missing ones again alone.

    A request holds `size` consecutive symbols of a source. Its answer is {"symbols": [{"symbol_id": ..., ...}]}; entries of ids
    that were not asked for do not count. Symbols without an entry are asked for one by one, with their texts cut once more.
    """
    rows = batching.numbered_batches(chunks.withColumn("text", S.truncated(F.col("text"), max_tokens)), size, "symbol_id", ["source"])
    entry = F.concat(F.lit("symbol_id: "), F.col("symbol_id").cast("string"), F.lit("\n"), F.col("text"))
    texts = batching.batch_texts(rows.withColumn("entry", entry), ["source", "batch"], "symbol_id", "entry")
    asked = texts.select(F.xxhash64("source", "batch").alias("chunk_seq"), F.col("batch_text").alias("prompt"))
    told = _entries(generated(asked, generator, workers, retry=False))
    first = batching.matched(rows.select("symbol_id", "text"), told.join(rows.select("symbol_id"), "symbol_id", "left_semi")).withColumn("attempt", F.lit(1))
    lost = batching.retry_set(rows.select("symbol_id", "text"), first.where("NOT success"))
    again = _entries(generated(lost.select(F.col("symbol_id").alias("chunk_seq"), F.concat(F.lit("symbol_id: "), F.col("symbol_id").cast("string"), F.lit("\n"), F.col("text")).alias("prompt")), generator, workers, retry=False))
    second = batching.matched(lost, again).withColumn("attempt", F.lit(2))
    return first.where("success").unionByName(second).select("symbol_id", "answer", "success", "attempt")


def _entries(results: DataFrame) -> DataFrame:
    """symbol_id, seq, answer (JSON) of each entry of the answers that succeeded."""
    listed = F.from_json(F.get_json_object(S.found_json(F.col("text")), "$.symbols"), "array<map<string,string>>")
    each = results.where("success").select(F.posexplode(listed).alias("seq", "e"))
    return each.select(F.expr("try_cast(e['symbol_id'] AS BIGINT)").alias("symbol_id"), "seq", F.to_json("e").alias("answer")).where("symbol_id IS NOT NULL")


def failures(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """path, error of failed results (chunk_seq, success, error) whose chunk (chunk_seq, path) is known."""
    return results.where("NOT success").join(chunks.select("chunk_seq", "path"), "chunk_seq").select("path", "error")


def run_statistics(files: DataFrame, chunks: DataFrame, results: DataFrame) -> DataFrame:
    """One row: total_files, total_chunks, doc_worthy_chunks, doc_worthy_percent (chunks have doc_worthy), llm_docs_generated."""
    n = files.agg(F.count("*").alias("total_files"))
    c = chunks.agg(F.count("*").alias("total_chunks"), F.count_if("doc_worthy").alias("doc_worthy_chunks"), F.round(100.0 * F.count_if("doc_worthy") / F.nullif(F.count("*"), F.lit(0)), 1).alias("doc_worthy_percent"))
    return n.join(F.broadcast(c)).join(F.broadcast(results.agg(F.count_if("success").alias("llm_docs_generated"))))  # one row each


def documentation(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """symbol_id, summary, description of successful results, joined to their chunks."""
    answer = F.from_json(S.found_json(F.col("answer")), "summary string, description string")
    rows = results.where("success").select("chunk_seq", F.col("text").alias("answer")).join(chunks.select("chunk_seq", "chunk_id"), "chunk_seq")
    return rows.select(F.col("chunk_id").alias("symbol_id"), F.coalesce(answer["summary"], F.substring("answer", 1, 200)).alias("summary"), answer["description"].alias("description"))


def totals(results: DataFrame, model: str) -> DataFrame:
    """One row: requests, how many succeeded and failed, tokens and cost at the model's prices."""
    usage = results.agg(F.count("*").alias("n"), F.count_if("success").alias("n_ok"), F.count_if(~F.col("success")).alias("n_failed"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens")])
    return batching.costs(usage.withColumn("model", F.lit(model)))
