"""Queries of the engine's own operators over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed
from .functions import scalar as S
from .operators import batching, chunkers, scoring, similarity, symbols
from .sources import files as file_sources

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _shared(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only where none is set, as in tests."""
    return spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="marlstone-")


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: path, text, size, doc_id."""
    ext = F.element_at(F.array(*[F.lit(e) for e in (".txt", ".md", ".json", ".py", ".rs")]), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), ext)
    return table(spark, d, "documents").select(path.alias("path"), "text", F.length("text").cast("long").alias("size"), "doc_id", "source")


_F = "f AS (SELECT source || '/' || lang || '/' || doc_id || (['.txt', '.md', '.json', '.py', '.rs'])[doc_id % 5 + 1] AS path, text, CAST(length(text) AS BIGINT) AS size, doc_id, source FROM documents)"
_W = _F + ", w AS (SELECT path, doc_id, CAST(i AS INTEGER) AS seq, CAST(i * 240 AS INTEGER) AS start, CAST(least(i * 240 + 240, size) AS INTEGER) AS stop, substring(text, i * 240 + 1, 240) AS text FROM f, unnest(range(0, CAST(ceil(size / 240.0) AS BIGINT))) AS u(i) WHERE regexp_matches(f.text, '[^\\s]'))"
_EXT = "CASE WHEN regexp_matches(path, '^.*[^/]+\\.[^./]+$') THEN lower(regexp_extract(path, '\\.[^./]+$')) ELSE '' END"


def _sql_list(values: list[str] | tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _sql_case(t: dict[str, str], key: str, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {key} = '{k}' THEN '{v}'" for k, v in t.items()) + f" ELSE {default} END"


def _sql_marks(marks: tuple, text: str, last: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join("contains({}, '{}')".format(text, m.replace("'", "''")) for m in ms) + f" THEN '{k}'" for k, ms in marks) + f" ELSE {last} END"


def _sql_cyclo(text: str) -> str:
    return "1 + " + " + ".join(f"len(regexp_extract_all({text}, '(?i){p}'))" for p in fixed.BRANCHES)


_CYCLO = _sql_cyclo("text")
_CPLX = "least(1.0, CASE WHEN length(text) >= 100 THEN 0.4 * least(1.0, length(text) / 1000.0::DOUBLE) ELSE 0 END + CASE WHEN cc >= 4 THEN 0.4 * least(1.0, cc / 10.0::DOUBLE) ELSE 0 END + CASE WHEN l1 <> 0 AND l2 <> 0 THEN 0.2 * least(1.0, (l2 - l1) / 200.0::DOUBLE) ELSE 0 END)"


@_query(f"WITH {_W} SELECT path, seq, start, stop, text FROM w")
def fixed_chunks(spark, d):
    return chunkers.fixed_windows(files(spark, d)).select("path", "seq", "start", "stop", "text")


@_query(f"WITH {_W} SELECT path, seq, 'chunk_' || substring(sha256('generic:' || path || ':' || start), 1, 12) AS chunk_id, 'chunk_' || substring(sha256(path), 1, 8) || '_' || lpad(CAST(seq AS VARCHAR), 6, '0') AS text_chunk_id FROM w")
def chunk_ids(spark, d):
    w = chunkers.fixed_windows(files(spark, d))
    return w.select("path", "seq", S.chunk_id(F.lit("generic"), F.col("path"), F.col("start")).alias("chunk_id"), S.text_chunk_id(F.col("path"), F.col("seq")).alias("text_chunk_id"))


@_query(f"WITH {_W} SELECT path, start, row_number() OVER (ORDER BY path, start) - 1 AS chunk_seq FROM w")
def chunk_sequence(spark, d):
    return chunkers.numbered(chunkers.fixed_windows(files(spark, d))).select("path", "start", F.col("chunk_seq").cast("long").alias("chunk_seq"))


@_query(f"SELECT doc_id, CAST({_CYCLO} AS INTEGER) AS cyclomatic FROM documents")
def cyclomatic(spark, d):
    return table(spark, d, "documents").select("doc_id", S.cyclomatic(F.col("text")).alias("cyclomatic"))


@_query(f"WITH c AS (SELECT doc_id, text, {_CYCLO} AS cc, doc_id % 7 AS l1, doc_id % 7 + doc_id % 300 AS l2 FROM documents) SELECT doc_id, round({_CPLX}, 4) AS complexity FROM c")
def complexity_score(spark, d):
    first = F.col("doc_id") % 7
    return table(spark, d, "documents").select("doc_id", F.round(S.complexity_score(F.col("text"), first, first + F.col("doc_id") % 300), 4).alias("complexity"))


_KINDS = ("function", "class", "import", "comment", "text", "section", "module")
_VIS = ("public", "private", "internal")
_STRUCT = (
    "CASE WHEN kind IN ('function', 'method', 'class', 'module', 'variable') THEN 1.0::DOUBLE WHEN kind IN ('import', 'comment') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END * CASE WHEN depth > 1 THEN power(0.8::DOUBLE, depth - 1) ELSE 1 END"
)
_SCORED = (
    f"k AS (SELECT doc_id, text, ({list(_KINDS)})[doc_id % 7 + 1] AS kind, CAST(doc_id % 4 AS INTEGER) AS depth, ({list(_VIS)})[doc_id % 3 + 1] AS vis, {_CYCLO} AS cc, 1 AS l1, 1 + doc_id % 100 AS l2 FROM documents), "
    f"p AS (SELECT *, {_STRUCT} AS base, {_CPLX} AS complexity FROM k), q AS (SELECT *, CASE vis WHEN 'public' THEN least(1.0, base * 1.2) WHEN 'private' THEN base * 0.7 ELSE base END AS structural FROM p)"
)


def _typed(spark, d):
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("doc_id") % n + 1).cast("int"))
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_seq"), F.concat_ws("/", "source", "lang").alias("path"), "text", pick(_KINDS, 7).alias("type"), (F.col("doc_id") % 4).cast("int").alias("depth"), pick(_VIS, 3).alias("visibility"),
        F.lit(1).alias("line_start"), (1 + F.col("doc_id") % 100).cast("int").alias("line_end"),
    )


@_query(f"WITH {_SCORED} SELECT doc_id AS chunk_seq, round(structural, 4) AS structural FROM q")
def structural_score(spark, d):
    return _typed(spark, d).select("chunk_seq", F.round(S.structural_score(F.col("type"), F.col("depth"), F.col("visibility")), 4).alias("structural"))


_VEC = (
    "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS z FROM v), "
    "u AS (SELECT id, e, list_transform(e, lambda x: x / CASE WHEN z = 0 THEN 1 ELSE z END) AS u FROM n)"
)
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
_MEANS = _VEC + (
    ", c AS (SELECT k, avg(e[k]) AS m, sum(u[k]) AS s FROM u, unnest(range(1, 65)) AS t(k) GROUP BY k), g AS (SELECT list(m ORDER BY k) AS m, list(s ORDER BY k) AS s FROM c), "
    f"cu AS (SELECT id, greatest(0, {_DOT.format(a='u', b='m')} / sqrt({_DOT.format(a='m', b='m')})) AS centroid, greatest(0, 1 - {_DOT.format(a='u', b='s')} / ((SELECT count(*) FROM u) - 1)) AS uniqueness FROM u, g), "
    f"dg AS (SELECT a.id, count(b.id) AS degree FROM u a LEFT JOIN u b ON a.id <> b.id AND {_DOT.format(a='a.u', b='b.u')} > 0.25 GROUP BY a.id), "
    "sem AS (SELECT cu.id, degree / greatest(max(degree) OVER (), 1) AS degree_score, centroid, uniqueness FROM cu JOIN dg ON cu.id = dg.id)"
)


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@_query(f"WITH {_MEANS} SELECT id, round(centroid, 4) AS centroid, round(uniqueness, 4) AS uniqueness FROM cu")
def centroid_uniqueness(spark, d):
    return similarity.centroid_and_uniqueness(_vectors(spark, d)).select("id", F.round("centroid", 4).alias("centroid"), F.round("uniqueness", 4).alias("uniqueness"))


@_query(f"WITH {_MEANS} SELECT id, degree FROM dg")
def degree_counts(spark, d):
    return similarity.degrees(_vectors(spark, d), 0.25)


_SEM = "0.4 * degree_score + 0.4 * centroid + 0.2 * uniqueness"


@_query(f"WITH {_MEANS} SELECT id, round(degree_score, 4) AS degree_score, round({_SEM}, 4) AS semantic FROM sem")
def semantic_score(spark, d):
    return scoring.semantic_scores(_vectors(spark, d), 0.25).select("id", F.round("degree_score", 4).alias("degree_score"), F.round("semantic", 4).alias("semantic"))


_DOC = f"{_SCORED}, {_MEANS}, sc AS (SELECT doc_id AS chunk_seq, round(0.5 * structural + 0.35 * coalesce({_SEM}, 0) + 0.15 * complexity, 4) AS score, round(0.5 * structural + 0.35 * coalesce({_SEM}, 0) + 0.15 * complexity, 6) AS raw, 0.5 * structural + 0.35 * coalesce({_SEM}, 0) + 0.15 * complexity >= 0.65 AS doc_worthy FROM q LEFT JOIN sem ON q.doc_id = sem.id)"


def _scored(spark, d):
    return scoring.doc_scores(_typed(spark, d), scoring.semantic_scores(_vectors(spark, d), 0.25))


@_query(f"WITH {_DOC} SELECT chunk_seq, raw AS score, doc_worthy FROM sc")
def doc_score(spark, d):
    return _scored(spark, d).select("chunk_seq", F.round("raw_score", 6).alias("score"), "doc_worthy")


@_query(f"WITH {_DOC} SELECT chunk_seq, score FROM sc WHERE score >= 0.65")
def doc_worthy(spark, d):
    return scoring.worthy(_scored(spark, d)).select("chunk_seq", "score")


@_query(f"WITH {_DOC} SELECT chunk_seq FROM sc WHERE doc_worthy OR NOT (SELECT bool_or(doc_worthy) FROM sc)")
def worthy_or_all(spark, d):
    return scoring.worthy_or_all(_scored(spark, d)).select("chunk_seq")


@_query(
    f"WITH {_DOC} SELECT count(*) AS n, round(avg(score), 4) AS mean, round(median(score), 4) AS median, min(score) AS low, max(score) AS high, round(stddev_pop(score), 4) AS deviation, "
    + ", ".join(f"round(quantile_cont(score, 0.{q}), 4) AS p{q}" for q in (25, 50, 75, 90, 95))
    + ", count(*) FILTER (WHERE score >= 0.65) AS n_worthy, round(100.0::DOUBLE * count(*) FILTER (WHERE score >= 0.65) / count(*), 2) AS percent_worthy FROM sc"
)
def score_stats(spark, d):
    s = scoring.score_statistics(_scored(spark, d))
    near = {c: F.round(c, 4) for c in ("mean", "median", "deviation", "p25", "p50", "p75", "p90", "p95")} | {"percent_worthy": F.round("percent_worthy", 2)}
    return s.withColumns(near)


@_query(f"WITH {_W} SELECT 'file:' || path AS symbol_id, 'File: ' || path AS summary, regexp_replace(regexp_replace(replace(substring(text, 1, 200), chr(10), ' '), '^\\s+', ''), '\\s+$', '') || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS description FROM w WHERE seq = 0")
def rule_based_docs(spark, d):
    return scoring.rule_based_docs(chunkers.fixed_windows(files(spark, d)).withColumn("chunk_seq", F.col("seq")))


_TOPC = f"{_W}, c AS (SELECT path, seq, text, {_CYCLO} AS cc, seq AS l1, seq + 10 AS l2 FROM w), s AS (SELECT path, seq, round({_CPLX}, 4) AS score FROM c)"


@_query(f"WITH {_TOPC} SELECT path, seq, score FROM s ORDER BY score DESC, path, seq LIMIT 20")
def top_chunks(spark, d):
    w = chunkers.fixed_windows(files(spark, d))
    return w.select("path", "seq", F.round(S.complexity_score(F.col("text"), F.col("seq"), F.col("seq") + 10), 4).alias("score")).orderBy(F.desc("score"), "path", "seq").limit(20)


@_query(f"WITH {_W}, r AS (SELECT path, start, row_number() OVER (PARTITION BY path ORDER BY start) AS rn, row_number() OVER (ORDER BY path, start) AS cs FROM w) SELECT path, start FROM r ORDER BY rn > 1, cs LIMIT 300")
def capped_spread(spark, d):
    return scoring.spread(chunkers.numbered(chunkers.fixed_windows(files(spark, d))), 300).select("path", "start")


_CODE = f"({_EXT}) IN {_sql_list(fixed.CODE_EXTENSIONS)}"


@_query(f"WITH {_F} SELECT source, round(avg(CASE WHEN {_CODE} THEN 1.0 ELSE 0.0 END), 4) AS code_ratio, avg(CASE WHEN {_CODE} THEN 1.0 ELSE 0.0 END) > 0.3 AS is_code, bool_or(({_EXT}) NOT IN {_sql_list(fixed.BINARY_EXTENSIONS)}) AS is_text FROM f GROUP BY source")
def domain_detect(spark, d):
    from .plans.ingestors import CodeIngestor, TextIngestor

    ratio = F.round(F.avg(S.is_code_file(F.col("path")).cast("double")), 4)
    return files(spark, d).groupBy("source").agg(ratio.alias("code_ratio"), CodeIngestor().detect().alias("is_code"), TextIngestor().detect().alias("is_text"))


@_query(f"WITH {_F} SELECT path, {_sql_case(fixed.LANGUAGES, _EXT)} AS language, {_sql_case(fixed.FORMATS, _EXT)} AS format, {_sql_case(fixed.PARSED, _EXT)} AS parsed FROM f")
def language_map(spark, d):
    p = F.col("path")
    return files(spark, d).select("path", S.language(p).alias("language"), S.text_format(p).alias("format"), S.parsed_language(p).alias("parsed"))


@_query(
    f"WITH {_F} SELECT path, regexp_extract(path, '[^/]+$') AS name, {_EXT} AS suffix, regexp_replace(regexp_extract(path, '[^/]+$'), '\\.[^.]+$', '') AS stem, CAST(len(string_split(path, '/')) AS INTEGER) AS n_parts, ({_EXT}) IN {_sql_list(fixed.TEXT_FILES)} AS is_text FROM f"
)
def path_parts(spark, d):
    p = F.col("path")
    return files(spark, d).select("path", S.basename(p).alias("name"), S.suffix(p).alias("suffix"), S.stem(p).alias("stem"), F.size(F.split(p, "/")).alias("n_parts"), S.is_text_file(p).alias("is_text"))


_LOW = "lower(text)"
_STRIP = "regexp_replace(regexp_replace(lower(text), '^\\s+', ''), '\\s+$', '')"
_SYNTH = "s AS (SELECT doc_id, (['def ', 'class ', 'import os ', '# note ', 'it(', 'try: ', 'fn main( ', '', 'struct x', 'new('])[doc_id % 10 + 1] || replace(replace(replace(text, 'from ', ''), 'use ', ''), 'error', '') AS text FROM documents)"


def _synthetic(spark, d):
    heads = ["def ", "class ", "import os ", "# note ", "it(", "try: ", "fn main( ", "", "struct x", "new("]
    body = F.replace(F.replace(F.replace("text", F.lit("from "), F.lit("")), F.lit("use "), F.lit("")), F.lit("error"), F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.concat(F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("doc_id") % 10 + 1).cast("int")), body).alias("text"))


_STARTS = " OR ".join("starts_with({}, '{}')".format("t", m.replace("'", "''")) for m in fixed.COMMENT_STARTS)


@_query(f"WITH {_SYNTH}, t AS (SELECT doc_id, {_STRIP} AS t FROM s) SELECT doc_id, " + _sql_marks(fixed.TYPE_MARKS, "t", f"CASE WHEN {_STARTS} THEN 'comment' ELSE 'text' END") + " AS type FROM t")
def infer_type(spark, d):
    return _synthetic(spark, d).select("doc_id", S.infer_type(F.col("text")).alias("type"))


@_query(f"WITH {_SYNTH} SELECT doc_id, " + _sql_marks(fixed.ROLE_MARKS, _LOW, "NULL") + " AS role FROM s")
def infer_role(spark, d):
    return _synthetic(spark, d).select("doc_id", S.infer_role(F.col("text")).alias("role"))


@_query("WITH k AS (SELECT doc_id, (['function', 'Method', 'struct', 'module', 'const', 'impl', 'typealias', 'interface'])[doc_id % 8 + 1] AS kind, (['paragraph', 'section', 'config', 'other'])[doc_id % 4 + 1] AS el FROM documents) SELECT doc_id, " + _sql_case(fixed.KIND_TYPES, "lower(kind)", "'text'") + " AS kind_type, " + _sql_case(fixed.ELEMENT_TYPES, "el", "'text'") + " AS element_type FROM k")
def type_maps(spark, d):
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("doc_id") % len(names) + 1).cast("int"))
    kinds = ("function", "Method", "struct", "module", "const", "impl", "typealias", "interface")
    return table(spark, d, "documents").select("doc_id", S.kind_type(pick(kinds)).alias("kind_type"), S.element_type(pick(("paragraph", "section", "config", "other"))).alias("element_type"))


_PRE = "(['', '.git/', 'node_modules/x/', 'a/build/', '.hidden/', 'docs/', 'build.d/'])[doc_id % 7 + 1]"


@_query(f"WITH {_F}, g AS (SELECT {_PRE} || path AS path, size * 100 AS size FROM f) SELECT path, size FROM g WHERE NOT list_has_any(string_split(path, '/')[1:-2], {fixed.SKIPPED_DIRECTORIES}) AND size <= 1000000")
def file_filter(spark, d):
    pre = F.element_at(F.array(*[F.lit(x) for x in ("", ".git/", "node_modules/x/", "a/build/", ".hidden/", "docs/", "build.d/")]), (F.col("doc_id") % 7 + 1).cast("int"))
    g = files(spark, d).select(F.concat(pre, "path").alias("path"), (F.col("size") * 100).alias("size"))
    return g.where(file_sources.wanted(F.col("path"), F.col("size")))


_TREE = f"{_F}, e AS (SELECT string_split(path, '/') AS p, size, i FROM f, unnest(range(1, 4)) AS t(i)), tr AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS path, array_to_string(p[1:i-1], '/') AS parent_path, p[i] AS name, CASE WHEN i = 3 THEN 'file' ELSE 'directory' END AS type, CASE WHEN i = 3 THEN size END AS size, CAST(i AS INTEGER) AS depth FROM e)"


@_query(f"WITH {_TREE} SELECT path, parent_path, name, type, coalesce(size, 0) AS size, depth FROM tr")
def file_tree(spark, d):
    return file_sources.tree(files(spark, d)).withColumn("size", F.coalesce("size", F.lit(0)))


@_query(f"WITH {_TREE} SELECT type, count(*) AS n, coalesce(sum(size), 0)::BIGINT AS bytes FROM tr GROUP BY type")
def file_count(spark, d):
    return file_sources.tree(files(spark, d)).groupBy("type").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


@_query("WITH u AS (SELECT doc_id, 'https://host.example/' || source || '/' || lang || (['', '/', '.git', '.git/', '/'])[doc_id % 5 + 1] AS url FROM documents) SELECT doc_id, 'https://github.com/' || regexp_extract(url, '/([^/]+)/([^/]+?)(\\.git)?/?$', 1) || '/' || regexp_extract(url, '/([^/]+)/([^/]+?)(\\.git)?/?$', 2) || '/archive/refs/heads/main.zip' AS archive, regexp_extract(url, '/([^/]+)/([^/]+?)(\\.git)?/?$', 2) || '.docpack' AS pack FROM u")
def source_names(spark, d):
    url = F.concat(F.lit("https://host.example/"), F.concat_ws("/", "source", "lang"), F.element_at(F.array(*[F.lit(x) for x in ("", "/", ".git", ".git/", "/")]), (F.col("doc_id") % 5 + 1).cast("int")))
    return table(spark, d, "documents").select("doc_id", S.archive_url(url).alias("archive"), S.output_name(url).alias("pack"))


_PATHS = (
    "lv AS (SELECT 'label_' || label AS path, vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), pm AS (SELECT path, k, avg(e[k]) AS x, min(id) AS first FROM lv, unnest(range(1, 65)) AS t(k) GROUP BY path, k), "
    "pl AS (SELECT path, min(first) AS first, list(x ORDER BY k) AS m FROM pm GROUP BY path), pn AS (SELECT path, row_number() OVER (ORDER BY first) - 1 AS ordinal, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS u FROM pl)"
)


def _paths(spark, d):
    v = _vectors(spark, d).select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("path"), F.col("id").alias("chunk_seq"), "embedding")
    return similarity.path_vectors(v)


@_query(f"WITH {_PATHS} SELECT path, ordinal, CAST(k - 1 AS INTEGER) AS k, round(u[k], 4) AS x FROM pn, unnest(range(1, 65)) AS t(k)")
def path_vectors(spark, d):
    return _paths(spark, d).select("path", "ordinal", F.posexplode("embedding").alias("k", "x")).withColumn("x", F.round("x", 4))


_EDGES = f"{_PATHS}, ed AS (SELECT a.ordinal AS i, b.ordinal AS j, {_DOT.format(a='a.u', b='b.u')} AS score FROM pn a JOIN pn b ON a.ordinal < b.ordinal), er AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS r FROM ed WHERE score >= 0.0), eg AS (SELECT i, j, score FROM er WHERE r <= 5)"


@_query(f"WITH {_EDGES} SELECT i, j, round(score, 4) AS score FROM eg")
def similarity_edges(spark, d):
    return similarity.similarity_edges(_paths(spark, d), 0.0).select("i", "j", F.round("score", 4).alias("score"))


@_query(f"WITH {_EDGES} SELECT count(*) AS n FROM ed WHERE score >= 0.7")
def edges_at_default(spark, d):
    return similarity.similarity_edges(_paths(spark, d)).agg(F.count("*").alias("n"))


@_query(f"WITH {_EDGES}, en AS (SELECT i AS id FROM eg UNION ALL SELECT j FROM eg) SELECT pn.ordinal AS id, count(en.id) AS degree, round(count(en.id) / greatest((SELECT count(*) FROM en), 1), 4) AS rank FROM pn LEFT JOIN en ON pn.ordinal = en.id GROUP BY 1")
def degree_rank(spark, d):
    p = _paths(spark, d)
    return similarity.degree_rank(p.select(F.col("ordinal").alias("id")), similarity.similarity_edges(p, 0.0))


_KNN = f"{_VEC}, kp AS (SELECT a.id AS i, b.id AS j, {_DOT.format(a='a.u', b='b.u')} AS score FROM u a JOIN u b ON a.id <> b.id), kr AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS r FROM kp), kn AS (SELECT i, j, score FROM kr WHERE r <= 3 AND score > 0.3)"


@_query(f"WITH {_KNN} SELECT i, j, round(score, 4) AS score FROM kn")
def semantic_neighbors(spark, d):
    return similarity.neighbors(_vectors(spark, d)).select("i", "j", F.round("score", 4).alias("score"))


@_query(f"WITH {_KNN}, t AS (SELECT kn.i AS id, '- ' || source || '/' || lang || ' (' || ({list(_KINDS)})[doc_id % 7 + 1] || ', ' || printf('%.4f', score) || '): ' || substring(text, 1, 200) AS s, score, j FROM kn JOIN documents ON j = doc_id) SELECT id, string_agg(s, chr(10) ORDER BY score DESC, j) AS context FROM t GROUP BY id")
def neighbor_context(spark, d):
    return scoring.neighbor_context(similarity.neighbors(_vectors(spark, d)), _typed(spark, d))


@_query("SELECT CASE WHEN t > 1000 THEN 'large' WHEN t >= 300 THEN 'medium' ELSE 'small' END AS size_class, count(*) AS n, CAST(sum(t) AS BIGINT) AS total_tokens FROM (SELECT length(text) // 4 AS t FROM documents) GROUP BY 1")
def token_classes(spark, d):
    return batching.token_classes(table(spark, d, "documents"))


_CUT = "CASE WHEN length(text) // 4 <= 400 THEN text ELSE regexp_replace(substring(text, 1, 1105), '\\s+$', '') || chr(10) || '... [truncated] ...' || chr(10) || regexp_replace(right(text, 473), '^\\s+', '') END"


@_query(f"SELECT doc_id, {_CUT} AS text, length(text) // 4 > 400 AS was_cut, substring(text, 1, CAST(floor(length(text) * 0.75) AS INTEGER)) || chr(10) || '... [truncated] ...' || chr(10) AS retry_text FROM documents")
def truncate_text(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", S.truncated(t, 400).alias("text"), (S.tokens(t) > 400).alias("was_cut"), S.retry_truncated(t).alias("retry_text"))


_PRICE = "pr(model, input, cached, output) AS (VALUES " + ", ".join("('{}', {})".format(m, ", ".join("NULL::DOUBLE" if v is None else f"{v}::DOUBLE" for v in usd)) for m, usd in fixed.PRICES.items()) + ")"
_MODELS = ("gpt-4o", "gpt-5-nano", "o1-pro", "gpt-image-1", "unheard-of")
_USAGE = f"us AS (SELECT ({list(_MODELS)})[conv_id % 5 + 1] AS model, sum(CASE WHEN role = 'user' THEN length(text) // 4 ELSE 0 END) AS it, sum(CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END) AS ot, sum(CASE WHEN role = 'system' THEN length(text) // 4 ELSE 0 END) AS ct FROM conversations GROUP BY 1)"


def _usage(spark, d):
    n = S.tokens(F.col("text"))
    part = lambda r: F.sum(F.when(F.col("role") == r, n).otherwise(0))
    model = F.element_at(F.array(*[F.lit(m) for m in _MODELS]), (F.col("conv_id") % 5 + 1).cast("int"))
    return table(spark, d, "conversations").groupBy(model.alias("model")).agg(part("user").alias("input_tokens"), part("assistant").alias("output_tokens"), part("system").alias("cached_tokens"))


@_query(f"WITH {_PRICE}, {_USAGE} SELECT us.model, CAST(it AS BIGINT) AS input_tokens, CAST(ot AS BIGINT) AS output_tokens, CAST(ct AS BIGINT) AS cached_tokens, round((coalesce(it / 1e6 * input, 0) + coalesce(ot / 1e6 * output, 0) + coalesce(ct / 1e6 * cached, 0)) * 0.5, 6) AS total_cost FROM us JOIN pr ON pr.model = CASE WHEN us.model IN (SELECT model FROM pr) THEN us.model ELSE 'gpt-5-nano' END")
def cost_by_model(spark, d):
    return batching.costs(_usage(spark, d), 0.5).select("model", "input_tokens", "output_tokens", "cached_tokens", F.round("total_cost", 6).alias("total_cost"))


@_query("SELECT source, count(*) AS n, CAST(ceil(count(*) / 15.0) AS BIGINT) AS batches, CAST(ceil(count(*) / 15.0) * 8650 AS BIGINT) AS input_tokens, CAST(ceil(count(*) / 15.0) * 6000 AS BIGINT) AS output_tokens, count(*) * 650 AS single_input, count(*) * 350 AS single_output, least(count(*) * 1024, 16384) AS output_cap FROM documents GROUP BY source")
def batch_plan(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    b, i, o = batching.batch_plan(F.col("n"), 15)
    si, so = batching.symbol_plan(F.col("n"))
    return g.select("source", "n", b.alias("batches"), i.cast("long").alias("input_tokens"), o.cast("long").alias("output_tokens"), si.alias("single_input"), so.alias("single_output"), S.output_cap(F.col("n")).alias("output_cap"))


@_query("WITH b AS (SELECT source, doc_id, text AS t, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 15 AS batch FROM documents) SELECT source, CAST(batch AS BIGINT) AS batch, string_agg(t, chr(10) || '---' || chr(10) ORDER BY doc_id) AS batch_text, count(*) AS n FROM b GROUP BY source, batch")
def batch_texts(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.col("text").alias("t"))
    return batching.batch_texts(batching.numbered_batches(rows, 15, "doc_id", ["source"]), ["source", "batch"], "doc_id", "t")


@_query("SELECT event_id, CAST(sum(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM events")
def token_budget_window(spark, d):
    usage = table(spark, d, "events").select("event_id", "user_id", "ts", F.floor(F.col("value") * 100).alias("tokens"))
    return batching.budget_window(usage, "user_id").select("event_id", "used")


_REQ = "rq AS (SELECT conv_id AS symbol_id, any_value(text) AS text FROM conversations WHERE turn = (0) GROUP BY conv_id), rs AS (SELECT conv_id AS symbol_id, turn AS seq, text AS answer FROM conversations WHERE role = 'assistant' AND conv_id % 4 <> 0)"


def _exchange(spark, d):
    c = table(spark, d, "conversations")
    asked = c.where("turn = 0").groupBy(F.col("conv_id").alias("symbol_id")).agg(F.any_value("text").alias("text"))
    return asked, c.where("role = 'assistant' AND conv_id % 4 <> 0").select(F.col("conv_id").alias("symbol_id"), F.col("turn").alias("seq"), F.col("text").alias("answer"))


@_query(f"WITH {_REQ} SELECT symbol_id FROM rq WHERE symbol_id NOT IN (SELECT symbol_id FROM rs)")
def batch_missing(spark, d):
    asked, told = _exchange(spark, d)
    return batching.missing(asked, told).select("symbol_id")


@_query(f"WITH {_REQ} SELECT symbol_id, substring(text, 1, CAST(floor(length(text) * 0.75) AS INTEGER)) || chr(10) || '... [truncated] ...' || chr(10) AS text FROM rq WHERE symbol_id NOT IN (SELECT symbol_id FROM rs)")
def retry_set(spark, d):
    asked, told = _exchange(spark, d)
    return batching.retry_set(asked, batching.missing(asked, told)).select("symbol_id", "text")


@_query(f"WITH {_REQ}, l AS (SELECT symbol_id, arg_max(answer, seq) AS answer FROM rs GROUP BY symbol_id) SELECT rq.symbol_id, answer, l.symbol_id IS NOT NULL AS success FROM rq LEFT JOIN l ON rq.symbol_id = l.symbol_id")
def doc_summary(spark, d):
    asked, told = _exchange(spark, d)
    return batching.matched(asked, told).select("symbol_id", "answer", "success")


@_query(f"WITH {_REQ}, l AS (SELECT DISTINCT symbol_id FROM rs) SELECT count(*) AS n, count(l.symbol_id) AS n_ok, count(*) - count(l.symbol_id) AS n_failed, CAST(sum(length(text) // 4) AS BIGINT) AS input_tokens FROM rq LEFT JOIN l ON rq.symbol_id = l.symbol_id")
def result_totals(spark, d):
    asked, told = _exchange(spark, d)
    return batching.matched(asked, told).agg(F.count("*").alias("n"), F.count_if("success").alias("n_ok"), F.count_if(~F.col("success")).alias("n_failed"), F.sum(S.tokens(F.col("text"))).alias("input_tokens"))


@_query("WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents) SELECT doc_id, CAST(i - 1 AS INTEGER) AS seq, s[i] AS sentence FROM s, unnest(range(1, len(s) + 1)) AS t(i)")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("seq", "sentence"))


def _blocks(spark, d):
    return files(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def _named(rows: DataFrame, ext: str) -> DataFrame:
    """All files, under this extension."""
    return rows.withColumn("path", F.regexp_replace("path", r"\.[^./]+$", ext))


@_query()
def paragraph_chunks(spark, d):
    return chunkers.text_chunks(_named(_blocks(spark, d), ".txt"))


@_query()
def markdown_sections(spark, d):
    md = _named(files(spark, d), ".md").withColumn("text", F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n\n## Part\n\n"))))
    return chunkers.text_chunks(md)


@_query()
def line_chunks(spark, d):
    return chunkers.text_chunks(_named(files(spark, d), ".json"))


@_query()
def long_text_chunks(spark, d):
    return chunkers.long_text_chunks(files(spark, d))


@_query()
def chunk_records(spark, d):
    return chunkers.chunk_records(chunkers.text_chunks(_blocks(spark, d))).withColumn("extra", F.to_json("extra"))


_CODE_TEXT = {
    "a/calc.py": 'class Calculator:\n    """Adds."""\n\n    def add(self, a, b: int, c=1):\n        return a\n\n    async def _run(self) -> int:\n        def inner(): pass\n        return 1\n\n\ndef top(x):\n    return x\n',
    "a/calc.rs": "/// Totals.\npub fn calculate_total(items: &[u32], tax: f32) -> u32 { 0 }\n\npub(crate) struct P { x: u8 }\nimpl P {\n    pub async fn go(&self, n: u8) -> u8 { n }\n    fn stop() {}\n}\nmod inner { pub const K: u8 = 1; }\npub trait T { fn t(&self); }\nenum E { A }\n",
    "a/calc.ts": "export class Store {\n  private n: number;\n  async get(key: string, n = 1): Promise<string> { return `}${key}`; }\n}\nfunction plain(a: number): void { if (a) { } }\ninterface Shape { area: number }\nconst arrow = () => 1;\n",
    "a/broken.py": "def (:\n" + "x = 1\n" * 100,
    "a/main.go": "package main\nfunc main() {}\n",
}


def _sources(spark):
    return spark.createDataFrame(list(_CODE_TEXT.items()), "path string, text string")


@_query("SELECT * FROM (VALUES ('a/calc.py', 'Calculator', 'class', 'public'), ('a/calc.py', 'Calculator::add', 'method', 'public'), ('a/calc.py', 'Calculator::_run', 'method', 'private'), ('a/calc.py', 'top', 'function', 'public')) AS t(path, qualified_name, kind, visibility)")
def python_symbols(spark, d):
    return symbols.symbols(_sources(spark).where(F.endswith("path", F.lit(".py")))).select("path", "qualified_name", "kind", "visibility")


@_query("SELECT * FROM (VALUES ('calculate_total', 'function', 'public'), ('P', 'struct', 'internal'), ('P::go', 'method', 'public'), ('P::stop', 'method', 'private'), ('K', 'const', 'public'), ('T', 'trait', 'public'), ('E', 'enum', 'private')) AS t(qualified_name, kind, visibility)")
def rust_symbols(spark, d):
    return symbols.symbols(_sources(spark).where(F.endswith("path", F.lit(".rs")))).select("qualified_name", "kind", "visibility")


@_query("SELECT * FROM (VALUES ('Store', 'class'), ('Store::get', 'method'), ('plain', 'function'), ('Shape', 'interface')) AS t(qualified_name, kind)")
def ts_symbols(spark, d):
    return symbols.symbols(_sources(spark).where(F.endswith("path", F.lit(".ts")))).select("qualified_name", "kind")


@_query("SELECT * FROM (VALUES ('a/broken.py', 3), ('a/calc.py', 4), ('a/calc.rs', 7), ('a/calc.ts', 4), ('a/main.go', 1)) AS t(path, n)")
def code_chunks(spark, d):
    return symbols.chunk_files(_sources(spark)).groupBy("path").agg(F.count("*").cast("int").alias("n"))


@_query("SELECT doc_id, text FROM documents WHERE regexp_matches(text, '[^\\s]')")
def decode_text(spark, d):
    raw = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"), F.lit(1).alias("size"))
    return file_sources.decoded(raw).select(F.col("path").cast("long").alias("doc_id"), "text")


@_query("SELECT vec_id AS chunk_seq, CAST(k - 1 AS INTEGER) AS k, CAST(embedding[k] AS FLOAT) AS x FROM embeddings, unnest(range(1, 65)) AS t(k)")
def embedding_roundtrip(spark, d):
    folder = f"{_shared(spark)}/embeddings-{uuid.uuid4().hex}"
    file_sources.write_embedding_parts(_vectors(spark, d).select(F.col("id").alias("chunk_seq"), "embedding"), folder)
    back = file_sources.read_embedding_parts(spark, folder, 64)
    return back.select("chunk_seq", F.posexplode("embedding").alias("k", "x"))


@_query(f"WITH {_W} SELECT count(DISTINCT path) AS total_files, count(*) AS total_chunks, 64 AS embedding_dimensions FROM w")
def pack_manifest(spark, d):
    w = chunkers.fixed_windows(files(spark, d))
    return w.agg(F.count_distinct("path").alias("total_files"), F.count("*").alias("total_chunks")).withColumn("embedding_dimensions", F.lit(64))


@_query()
def hash_embed(spark, d):
    from .plans.embedding import embedded

    return embedded(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_seq"), "text"))


@_query(f"SELECT doc_id AS chunk_seq, 'Describe the main points. Answer in JSON.' || chr(10) || chr(10) || chr(10) || {_CUT.replace('400', '800').replace('1105', '2225').replace('473', '953')} AS prompt FROM documents")
def prompt_render(spark, d):
    from .plans.documents import prompts

    return prompts(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_seq"), F.lit("none").alias("domain"), "text"))


@_query("SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN CAST(doc_id AS VARCHAR) END AS summary FROM documents")
def parse_llm_json(spark, d):
    doc = F.col("doc_id").cast("string")
    body = F.concat(F.lit('{"summary": '), doc, F.lit("}"))
    answer = F.when(F.col("doc_id") % 4 == 0, body).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\n{bad"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Sure! "), body, F.lit(" Bye"))).otherwise("none {at all")
    return table(spark, d, "documents").select("doc_id", F.get_json_object(S.found_json(answer), "$.summary").alias("summary"))


@_query()
def stream_budget(spark, d):
    from .streaming.budget import budget_stream

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    usage = events.select((F.col("user_id") % 4).alias("worker"), F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("value") * 100).alias("tokens"))
    name = f"budget-{uuid.uuid4().hex}"
    base = _shared(spark)
    query = budget_stream(usage).writeStream.format("parquet").option("path", f"{base}/{name}").option("checkpointLocation", f"{base}/{name}-state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("worker long, ts timestamp, tokens long, admitted_at timestamp").parquet(f"{base}/{name}")


def queries() -> dict[str, Query]:
    from . import plan_queries  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import plan_queries  # noqa: F401

    return dict(_ORACLES)
