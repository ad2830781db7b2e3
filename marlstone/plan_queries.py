"""Queries of the engine's plans over the driver's tables: sources, parsing with metadata, generation, records, packs; each with its SQL."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import chunkers, scoring, symbols
from .plans import documents, ingestors
from .queries import _CODE, _F, _SCORED, _TOPC, _TREE, _W, _query, _typed, files, table
from .sources import files as file_sources
from .sources import pack


def _folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="marlstone-")
    return f"{base}/marlstone-{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, d: str, ext: str, lines: list[str]) -> DataFrame:
    """A source file for each document: its whole text as a comment, then the lines, with the doc_id for each {}."""
    note = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", " ")
    i = F.col("doc_id").cast("string")
    mark = "# " if ext == ".py" else "// "
    body = F.replace(F.lit("\n".join(lines) + "\n"), F.lit("{}"), i)
    return table(spark, d, "documents").select(F.concat(F.lit("src/f"), i, F.lit(ext)).alias("path"), F.concat(F.lit(mark), note, F.lit("\n"), body).alias("text"))


_PYTHON = ["class C{}(Base):", '    """Doc {}."""', "", "    @cached", "    async def _run(self, a, b: int, c=1, *rest) -> str:", '        """Runs {}."""', "        return {}", "", "def top_{}(x: float, y='z'):", "    return x"]
_RUST = ["/// Sums {}.", "", "pub(crate) async unsafe fn sum_{}(items: &[u32], tax: f32) -> u32 { 0 }", "struct S{};", "impl Run for S{} {", "    pub fn go(&mut self, n: u8) -> Option<u8> { None }", "}"]
_TYPESCRIPT = ["export class Store{} {", "  async get(key: string, n = 1): Promise<string> { return key; }", "}", "function plain{}(a: number, b?: Map<string, number>): void { if (a) { } }"]

_SIGNED = ("path", "qualified_name", "kind", "visibility", "line_start", "line_end", "doc_comment", "parameters", "return_type", "modifiers")


def _signatures(rows: DataFrame) -> DataFrame:
    listed = F.transform("parameters", lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(":"), p["type_annotation"]), F.lit("")), F.coalesce(F.concat(F.lit("="), p["default_value"]), F.lit(""))))
    return symbols.symbols(rows).withColumn("parameters", F.array_join(listed, ";")).withColumn("modifiers", F.array_join("modifiers", ";")).select(*_SIGNED)


def _sql_symbols(ext: str, rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "replace('{}', '{{}}', CAST(doc_id AS VARCHAR))".format(v.replace("'", "''"))
    kinds = ["VARCHAR"] * 3 + ["INTEGER"] * 2 + ["VARCHAR"] * 4
    return " UNION ALL ".join(f"SELECT 'src/f' || doc_id || '{ext}' AS path, " + ", ".join(f"CAST({cell(v)} AS {k}) AS {n}" for n, v, k in zip(_SIGNED[1:], r, kinds, strict=True)) + " FROM documents" for r in rows)


@_query(
    _sql_symbols(
        ".py",
        [
            ("C{}", "class", "public", 2, 8, "Doc {}.", None, None, None),
            ("C{}::_run", "method", "private", 6, 8, "Runs {}.", "self;a;b:int;c=1", "str", "async;@cached"),
            ("top_{}", "function", "public", 10, 11, None, "x:float;y='z'", None, ""),
        ],
    )
)
def python_signatures(spark, d):
    return _signatures(_written(spark, d, ".py", _PYTHON))


@_query(
    _sql_symbols(
        ".rs",
        [
            ("sum_{}", "function", "internal", 4, 4, "Sums {}.", "items:&[u32];tax:f32", "u32", "async;unsafe"),
            ("S{}", "struct", "private", 5, 5, None, None, None, None),
            ("S{}::go", "method", "public", 7, 7, None, "n:u8", "Option<u8>", ""),
        ],
    )
)
def rust_signatures(spark, d):
    return _signatures(_written(spark, d, ".rs", _RUST))


@_query(
    _sql_symbols(
        ".ts",
        [
            ("Store{}", "class", "public", 2, 4, None, None, None, None),
            ("Store{}::get", "method", "public", 3, 3, None, "key:string;n=1", "Promise<string>", ""),
            ("plain{}", "function", "public", 5, 5, None, "a:number;b:Map<string, number>", "void", ""),
        ],
    )
)
def ts_signatures(spark, d):
    return _signatures(_written(spark, d, ".ts", _TYPESCRIPT))


def _code_chunks(spark, d):
    rows = _written(spark, d, ".py", _PYTHON)
    return ingestors.CodeIngestor().chunks(rows.select("path", F.encode("text", "UTF-8").alias("content"), F.length("text").cast("long").alias("size")))


_INFO = (
    "SELECT 'src/f' || doc_id || '.py::C' || doc_id || '::_run' AS chunk_id, 'function' AS type, 'method' AS role, 'python' AS language, 6 AS line_start, chr(10) || '=== CODE SYMBOL METADATA ===' || chr(10) || '**Name:** _run' || chr(10) || '**Qualified Name:** C' || doc_id || '::_run' || chr(10)"
    " || '**Kind:** method' || chr(10) || '**Visibility:** private' || chr(10) || '**Location:** Lines 6-8' || chr(10) || chr(10) || '**Signature:**' || chr(10) || 'Parameters:' || chr(10) || '  - self' || chr(10) || '  - a' || chr(10) || '  - b: int' || chr(10) || '  - c = 1' || chr(10)"
    " || 'Returns: str' || chr(10) || '**Modifiers:** async, @cached' || chr(10) || '**Parent:** C' || doc_id || chr(10) || chr(10) || '**Existing Doc Comment:**' || chr(10) || '```' || chr(10) || 'Runs ' || doc_id || '.' || chr(10) || '```' || chr(10) || '=== END SYMBOL METADATA ===' || chr(10) AS info FROM documents"
)


@_query(_INFO)
def symbol_metadata(spark, d):
    rows = _code_chunks(spark, d).where("symbol_name = '_run'")
    return rows.select("chunk_id", "type", "role", "language", "line_start", documents.symbol_info(F.col("metadata")).alias("info"))


@_query("SELECT type, role, count(*) AS n FROM (SELECT unnest([{'type': 'class', 'role': 'class'}, {'type': 'function', 'role': 'method'}, {'type': 'function', 'role': 'function'}], recursive := true) FROM documents) GROUP BY ALL")
def code_ingest(spark, d):
    return _code_chunks(spark, d).groupBy("type", "role").agg(F.count("*").alias("n"))


@_query(f"WITH {_SCORED}, rk AS (SELECT source || '/' || lang AS path, round(count(*) / (SELECT count(*) FROM documents), 4) AS rank FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1), b AS (SELECT q.doc_id, structural, complexity, least(1.0, (q.doc_id % 10) / 10.0 * (1 + 0.3 * coalesce(rank, 0))) AS semantic FROM q JOIN documents x ON x.doc_id = q.doc_id LEFT JOIN rk ON rk.path = x.source || '/' || x.lang) SELECT doc_id AS chunk_seq, round(semantic + 1e-9, 4) AS semantic, round(0.5 * structural + 0.35 * semantic + 0.15 * complexity + 1e-9, 5) AS score FROM b")
def graph_boost(spark, d):
    docs = table(spark, d, "documents")
    n = docs.agg(F.count("*").alias("all"))
    ranks = docs.where("doc_id % 3 <> 0").groupBy(F.concat_ws("/", "source", "lang").alias("path")).agg(F.count("*").alias("n")).join(F.broadcast(n)).select("path", F.round(F.col("n") / F.col("all"), 4).alias("rank"))
    meaning = docs.select(F.col("doc_id").alias("id"), ((F.col("doc_id") % 10) / 10.0).alias("semantic"))
    return scoring.doc_scores(_typed(spark, d), meaning, ranks).select("chunk_seq", F.round(F.col("semantic") + 1e-9, 4).alias("semantic"), F.round(F.col("raw_score") + 1e-9, 5).alias("score"))


@_query(f"WITH {_TOPC} SELECT path, chunk_seq, score FROM (SELECT path, seq, score, row_number() OVER (ORDER BY path, seq) - 1 AS chunk_seq FROM s) ORDER BY score DESC, chunk_seq LIMIT 25")
def best_chunks(spark, d):
    w = chunkers.numbered(chunkers.fixed_windows(files(spark, d)))
    scored = w.withColumn("score", F.round(S.complexity_score(F.col("text"), F.col("seq"), F.col("seq") + 10), 4))
    return scoring.best(scored, 25).select("path", F.col("chunk_seq").cast("long").alias("chunk_seq"), "score")


class _Forgetful:
    """Answers for each symbol_id in a prompt, but for some at first and for others never; for the validation of batches."""

    def generate(self, prompts: list[str]) -> list[dict]:
        out = []
        for p in prompts:
            ids = [int(x) for x in re.findall(r"^symbol_id: (-?\d+)$", p, re.M)]
            kept = [i for i in ids if i % 11 != 5 and (i % 7 != 3 or p.endswith(S.MARKER))]
            answer = {"symbols": [{"symbol_id": i, "summary": f"s{i}"} for i in [*kept, -1]]}
            out.append({"text": f"Here you are:\n```json\n{json.dumps(answer)}\n```", "input_tokens": 1, "cached_tokens": 0, "output_tokens": 1, "success": True, "error": None})
        return out


@_query("SELECT doc_id AS symbol_id, CASE WHEN doc_id % 11 <> 5 THEN 's' || doc_id END AS summary, doc_id % 11 <> 5 AS success, CAST(CASE WHEN doc_id % 11 = 5 OR doc_id % 7 = 3 THEN 2 ELSE 1 END AS INTEGER) AS attempt FROM documents")
def batched_documentation(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("symbol_id"), "source", F.coalesce("text", F.lit("")).alias("text"))
    return documents.batched(rows, _Forgetful()).select("symbol_id", F.get_json_object("answer", "$.summary").alias("summary"), "success", "attempt")


class _Refusing:
    """Fails for each prompt that begins with a number divisible by 5."""

    def generate(self, prompts: list[str]) -> list[dict]:
        n = [int(p.split(" ", 1)[0]) for p in prompts]
        return [{"text": json.dumps({"summary": f"s{i}"}), "input_tokens": 100, "cached_tokens": 10, "output_tokens": 20, "success": i % 5 != 0, "error": None if i % 5 else f"refused {i}"} for i in n]


def _results(spark, d):
    asked = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_seq"), F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("text", F.lit(""))).alias("prompt"))
    return documents.generated(asked, _Refusing())


@_query(f"WITH {_F} SELECT path, 'refused ' || doc_id AS error FROM f WHERE doc_id % 5 = 0")
def failure_report(spark, d):
    return documents.failures(_results(spark, d), files(spark, d).select(F.col("doc_id").alias("chunk_seq"), "path"))


@_query("SELECT 'doc_' || doc_id AS symbol_id, 's' || doc_id AS summary FROM documents WHERE doc_id % 5 <> 0")
def documentation_rows(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_seq"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("chunk_id"))
    return documents.documentation(_results(spark, d), chunks).select("symbol_id", "summary")


@_query("SELECT 'gpt-4o' AS model, count(*) AS n, count(*) FILTER (WHERE doc_id % 5 <> 0) AS n_ok, count(*) FILTER (WHERE doc_id % 5 = 0) AS n_failed, count(*) * 100 AS input_tokens, count(*) * 10 AS cached_tokens, count(*) * 20 AS output_tokens, round(count(*) * (100 * 2.5 + 10 * 1.25 + 20 * 10.0) / 1e6, 6) AS total_cost FROM documents")
def generation_totals(spark, d):
    t = documents.totals(_results(spark, d), "gpt-4o")
    return t.select("model", "n", "n_ok", "n_failed", "input_tokens", "cached_tokens", "output_tokens", F.round("total_cost", 6).alias("total_cost"))


@_query(f"WITH {_SCORED}, z AS (SELECT 0.5 * structural + 0.15 * complexity >= 0.5 AS w FROM q) SELECT (SELECT count(DISTINCT source || '/' || lang) FROM documents) AS total_files, count(*) AS total_chunks, count(*) FILTER (WHERE w) AS doc_worthy_chunks, round(100.0::DOUBLE * count(*) FILTER (WHERE w) / count(*), 1) AS doc_worthy_percent, (SELECT count(*) FROM documents WHERE doc_id % 5 <> 0) AS llm_docs_generated FROM z")
def run_statistics(spark, d):
    typed = _typed(spark, d)
    return documents.run_statistics(typed.select("path").distinct(), scoring.doc_scores(typed, threshold=0.5), _results(spark, d))


@_query(f"WITH {_W} SELECT path, seq, start, stop, text FROM w")
def ingest_json(spark, d):
    folder = file_sources.write_ingest(chunkers.fixed_windows(files(spark, d)), _folder(spark, "ingest"))
    return file_sources.read_ingest(spark, folder, "path string, seq int, start int, stop int, text string")


@_query(f"WITH {_W} SELECT 'chunk_' || substring(sha256('generic:' || path || ':' || start), 1, 12) AS chunk_id, 'generic' AS domain, CASE WHEN doc_id % 3 = 2 THEN '' ELSE path END AS path, CASE WHEN doc_id % 2 = 0 THEN 'paragraph' ELSE 'text' END AS type, text, start, stop, 0 AS depth FROM w")
def chunk_json(spark, d):
    w = chunkers.fixed_windows(files(spark, d))
    i = F.regexp_extract("path", r"([0-9]+)\.[a-z]+$", 1).cast("long")
    rows = w.select(
        S.chunk_id(F.lit("generic"), F.col("path"), F.col("start")).alias("chunk_id"), F.lit(None).cast("string").alias("domain"), F.when(i % 3 != 2, F.col("path")).alias("path"), F.when(i % 2 == 0, F.lit("paragraph")).alias("type"), "text", "start", "stop",
        *(F.lit(None).cast(k).alias(c) for c, k in (("language", "string"), ("line_start", "int"), ("line_end", "int"), ("depth", "int"))), i.alias("i"),
    )
    # Every other record names its path as older ones do.
    told = chunkers.record_json(rows).select(F.when(F.crc32("chunk_id") % 2 == 0, F.regexp_replace("json", '"path":', '"file_path":')).otherwise(F.col("json")).alias("json"))
    return chunkers.records_of_json(told).select("chunk_id", "domain", "path", "type", "text", "start", "stop", "depth")


@_query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'description' WHEN 2 THEN 'summary,description' ELSE 'summary,description' END AS lacking FROM documents")
def required_keys(spark, d):
    json_ = F.when(F.col("doc_id") % 4 == 0, '{"summary": 1, "description": null, "x": 2}').when(F.col("doc_id") % 4 == 1, '{"summary": "a"}').when(F.col("doc_id") % 4 == 2, "{}").otherwise("[1]")
    return table(spark, d, "documents").select("doc_id", F.array_join(S.lacking_keys(json_, ["summary", "description"]), ",").alias("lacking"))


@_query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '[1,' || doc_id || ']' WHEN 1 THEN '{\"a\":' || doc_id || '}' WHEN 2 THEN '{\"b\":' || doc_id || '}' END AS found FROM documents")
def fenced_json(spark, d):
    i = F.col("doc_id").cast("string")
    answer = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("List:\n```json\n[1, "), i, F.lit("]\n```")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("First\n```\nnot {json\n```\nthen\n```json\n{\"a\": "), i, F.lit("}\n```\nand {more")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Well, {\"b\": "), i, F.lit("} it is")))
        .otherwise("nothing")
    )
    return table(spark, d, "documents").select("doc_id", S.found_json(answer).alias("found"))


@_query(f"WITH {_W}, n AS (SELECT *, row_number() OVER (ORDER BY path, start) - 1 AS cs, 'chunk_' || substring(sha256('generic:' || path || ':' || start), 1, 12) AS id FROM w) SELECT path, CASE WHEN min(cs) % 2 = 0 THEN 'code' ELSE 'generic' END AS domain, min(cs) AS first, string_agg(id, ',' ORDER BY cs) AS chunk_ids FROM n GROUP BY path")
def ids_per_path(spark, d):
    w = chunkers.numbered(chunkers.fixed_windows(files(spark, d)))
    rows = w.select("path", F.col("chunk_seq").cast("long").alias("chunk_seq"), S.chunk_id(F.lit("generic"), F.col("path"), F.col("start")).alias("chunk_id"), F.when(F.col("chunk_seq") % 2 == 0, "code").otherwise("generic").alias("domain"))
    return chunkers.ids_per_path(rows).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@_query(f"WITH {_TREE} SELECT path, row_number() OVER (PARTITION BY parent_path ORDER BY type = 'file', name) AS place FROM tr")
def tree_order(spark, d):
    from pyspark.sql import Window

    rows = file_sources.tree(files(spark, d))
    return rows.select("path", F.row_number().over(Window.partitionBy("parent_path").orderBy(*file_sources.tree_order()[1:])).cast("long").alias("place"))


@_query("SELECT source || '-' || (doc_id % 16) || '.zip' AS archive, doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS size, text FROM documents WHERE regexp_matches(text, '[^\\s]')")
def zip_members(spark, d):
    import io
    import zipfile

    import pandas as pd

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("top/", "")
            z.writestr("../out.txt", "unsafe")
            z.writestr("/abs.txt", "unsafe")
            for i, text in zip(rows["doc_id"], rows["text"], strict=True):
                z.writestr(f"top/{i}.txt", (text or "").encode())
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "content": [held.getvalue()]})

    name = F.concat("source", F.lit("-"), (F.col("doc_id") % 16).cast("string"), F.lit(".zip"))
    zips = table(spark, d, "documents").select(name.alias("path"), "doc_id", "text").groupBy("path").applyInPandas(build, "path string, content binary")
    members = file_sources.rooted(file_sources.unzipped(zips))
    text = file_sources.decoded(members.select(F.concat_ws("|", "archive", "path").alias("path"), "content", "size"))
    return text.select(F.split("path", r"\|")[0].alias("archive"), F.split("path", r"\|")[1].alias("path"), "size", "text")


@_query(f"WITH {_F}, a AS (SELECT CASE WHEN avg(CASE WHEN {_CODE} THEN 1.0 ELSE 0.0 END) > 0.3 THEN 'code' ELSE 'generic_text' END AS auto FROM f) SELECT 'none' AS forced, auto AS chosen FROM a UNION ALL SELECT 'generic_text', 'generic_text' UNION ALL SELECT 'unheard-of', auto FROM a UNION ALL SELECT 'text files only', 'generic_text'")
def ingestor_choice(spark, d):
    import warnings

    class Broken(ingestors.TextIngestor):
        name, priority = "broken", 1000

        def detect(self):
            return F.raise_error(F.lit("no"))

    rows, registry = files(spark, d), ingestors.default_registry()
    registry.register(Broken())
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        picked = [(str(f or "none"), registry.select(rows, f).name) for f in (None, "generic_text", "unheard-of")]
        picked.append(("text files only", registry.select(rows.where(F.endswith("path", F.lit(".txt")))).name))
    return spark.createDataFrame(picked, "forced string, chosen string")


@_query(f"WITH {_W} SELECT '6.1.0' AS version, (SELECT count(*) FROM f) AS total_files, count(DISTINCT path) AS chunked_files, count(*) AS total_chunks, 64 AS dims, 'generic' AS domain FROM w")
def manifest_row(spark, d):
    rows = files(spark, d)
    m = pack.manifest(rows, chunkers.fixed_windows(rows), {"location": d}, "generic", "generic_text", 64, "hash-64")
    return spark.createDataFrame([(m["docpack_version"], m["total_files"], m["chunked_files"], m["total_chunks"], m["embedding_dimensions"], m["domain"])], "version string, total_files long, chunked_files long, total_chunks long, dims int, domain string")
