import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.functions import scalar as S
from marlstone.operators import batching, chunkers, scoring, similarity, symbols
from marlstone.plans import documents
from marlstone.plans.build import Config, build, write
from marlstone.plans.ingestors import CodeIngestor, TextIngestor, default_registry
from marlstone.sources import files as fs
from marlstone.sources import pack


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("kind", "depth", "vis", "want"), [("function", 1, "public", 1.0), ("function", 1, "private", 0.7), ("import", 3, None, 0.192), ("section", 1, "public", 0.0), ("module", 1, None, 1.0)])
def test_structural_score(spark, kind, depth, vis, want):
    assert one(spark, S.structural_score(F.lit(kind), F.lit(depth), F.lit(vis).cast("string"))) == pytest.approx(want)


@pytest.mark.parametrize(("text", "want"), [("if a and b: pass", 3), ("else if (x)", 3), ("elif", 2), ("", 1), ("a ? b : c && d || e", 4), ("a ?: b", 1)])
def test_cyclomatic(spark, text, want):
    assert one(spark, S.cyclomatic(F.lit(text))) == want


def test_complexity(spark):
    assert one(spark, S.complexity_score(F.lit("x" * 99), F.lit(1), F.lit(3), F.lit(3))) == pytest.approx(0.002)
    assert one(spark, S.complexity_score(F.lit("x" * 500), F.lit(10), F.lit(60), F.lit(5))) == pytest.approx(0.45)
    assert one(spark, S.weighted_score(F.lit(1.0), F.lit(0.82), F.lit(0.70))) == pytest.approx(0.892)
    assert one(spark, S.boosted(F.lit(0.9), F.lit(0.5))) == 1.0
    with pytest.raises(ValueError):
        S.weighted_score(F.lit(1.0), F.lit(1.0), F.lit(1.0), (0.5, 0.5, 0.5))


def test_truncation_and_preview(spark):
    cut = one(spark, S.truncated(F.lit("a" * 2000), 400))
    assert len(cut) == 1105 + 21 + 473 and S.MARKER in cut
    assert one(spark, S.truncated(F.lit("a" * 1603), 400)) == "a" * 1603
    assert one(spark, S.truncated(F.lit("a" * 100), 5)) == S.MARKER
    assert one(spark, S.preview(F.lit(" a\nb" + "c" * 300))) == "a b" + "c" * 196 + "..."


def test_costs(spark):
    rows = spark.createDataFrame([("gpt-4o", 32150, 12850, 0), ("gpt-image-1", 1000, 10, 0), ("nothing", 1_000_000, 0, 0)], "model string, input_tokens long, output_tokens long, cached_tokens long")
    got = {r.model: r.total_cost for r in batching.costs(rows).collect()}
    assert got["gpt-4o"] == pytest.approx(0.208875) and got["gpt-image-1"] == pytest.approx(0.005) and got["nothing"] == pytest.approx(0.05)
    assert batching.prices(spark).count() == 40
    assert [one(spark, c) for c in batching.batch_plan(F.lit(67), 15)] == [5, 43250, 30000]


def test_fixed_windows(spark):
    rows = spark.createDataFrame([("a", "é" * 500), ("b", " \n"), ("c", None), ("d", "")], "path string, text string")
    assert [(r.start, r.stop) for r in chunkers.fixed_windows(rows).orderBy("start").collect()] == [(0, 240), (240, 480), (480, 500)]


def packed(parts, size):
    """Greedy packing, plainly: each part costs its length and one."""
    out, held = [], []
    for p in parts:
        if held and (len(p) > size or sum(len(h) + 1 for h in held) + len(p) + 1 > size):
            out.append(" ".join(held))
            held = []
        if len(p) > size:
            out += [p] if " " not in p else packed(p.split(), size)
        else:
            held.append(p)
    return out + ([" ".join(held)] if held else [])


def test_long_text():
    rng = random.Random(3)
    for _ in range(50):
        text = " ".join("w" * rng.choice([1, 3, 9, 60]) + rng.choice(["", "", ".", "?!"]) for _ in range(rng.randrange(1, 60)))
        assert chunkers.long_text(text, 50) == packed(re.split(r"(?<=[.!?])\s+", text), 50)
    assert chunkers.long_text("x" * 600, 500) == ["x" * 600]


def test_paragraphs_lines_sections():
    sizes = (10, 200, 490, 600, 50)
    got = chunkers.paragraphs("\n\n".join("p" * n for n in sizes), 500, 100)
    assert [len(t) for t, *_ in got] == [212, 490, 600] and [(a, b) for _, a, b in got] == [(0, 212), (214, 704), (706, 1306)]
    assert chunkers.paragraphs("short", 500, 100) == []
    whole = "\n".join("l" * 99 for _ in range(20))
    lines = chunkers.packed_lines(whole, 500, 100)
    assert [(x, y) for *_, x, y in lines] == [(1, 5), (6, 10), (11, 15), (16, 20)] and "\n".join(t for t, *_ in lines) == whole
    assert len(chunkers.packed_lines("x" * 700, 500, 100)) == 1
    md = "Before " * 20 + "\n# One\n\n" + "body " * 30 + "\n## Lost\n## Two\nshort\n### Last " + "h" * 120
    got = chunkers.sections(md, 500, 100)
    assert [(h and h[:6], level) for *_, h, level in got] == [(None, 1), ("# One", 1), ("### La", 3)]
    assert got[1][0].startswith("# One\n\nbody") and got[1][1] == len(got[0][0]) + 2
    assert [r[0] for r in chunkers.split_file("a.json", "x" * 1000, 500, 100)] == ["config"] and chunkers.split_file("a.json", "x\n" * 501, 500, 100)[0][0] == "text"


def test_numbering_does_not_depend_on_partitions(spark):
    rows = chunkers.fixed_windows(spark.createDataFrame([(f"p{k}", "t" * (100 * k)) for k in range(1, 12)], "path string, text string"))
    a = chunkers.numbered(rows.repartition(5)).orderBy("path", "start").collect()
    b = chunkers.numbered(rows.coalesce(1)).orderBy("path", "start").collect()
    assert a == b and [r.chunk_seq for r in a] == list(range(len(a)))


def test_symbols():
    rust = {s["qualified_name"]: s for s in symbols.rust_symbols('/// Adds {\npub async unsafe fn add<T>(a: Vec<(u8, T)>, b: &str) -> Result<u8, E> where T: X { let s = "}"; 0 }\nimpl Show for P<T> { fn show(&self) {} }\nimpl Q { fn show(&mut self, n: u8); }\npub(super) static N: u8 = 1;')}
    add = rust["add"]
    assert add["visibility"] == "public" and add["doc_comment"] == "Adds {" and add["return_type"] == "Result<u8, E>" and add["modifiers"] == ["async", "unsafe"]
    assert [(p["name"], p["type_annotation"]) for p in add["parameters"]] == [("a", "Vec<(u8, T)>"), ("b", "&str")]
    assert rust["P<T>::show"]["kind"] == "method" and rust["Q::show"]["parameters"][0]["name"] == "n" and rust["N"]["kind"] == "const"
    py = {s["qualified_name"]: s for s in symbols.python_symbols('@dec\ndef f(a, b: int, c=1, d: int = 2, *e) -> str:\n    """Doc."""\n    def inner(): ...\nclass C:\n    async def _m(self): ...\nx = 1\n')}
    assert set(py) == {"f", "C", "C::_m"} and py["f"]["doc_comment"] == "Doc." and [p["name"] for p in py["f"]["parameters"]] == ["a", "b", "c"]
    assert py["f"]["modifiers"] == ["@dec"] and py["C::_m"]["visibility"] == "private" and py["f"]["line_end"] == 4
    assert symbols.python_symbols("def (") == []
    ts = {s["qualified_name"]: s for s in symbols.ts_symbols('// function no() {}\nexport async function f(a: number, b?: string): Promise<void> { return; }\nclass A extends B {\n  constructor(x: string) { if (x) {} }\n  static m() { return "}"; }\n}\ninterface I { m(): void }\nconst g = () => 1;')}
    assert set(ts) == {"f", "A", "A::constructor", "A::m", "I"} and ts["f"]["return_type"] == "Promise<void>" and [p["name"] for p in ts["f"]["parameters"]] == ["a", "b"]


def vectors(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(rows)], "id long, embedding array<float>")


def test_similarity(spark):
    v = vectors(spark, [[1.0, 0, 0], [1.0, 0, 0], [0, 1.0, 0], [0, 1.0, 0], [0, 0, 1.0], [0.0, 0, 0]])
    for size in (2, 1024):
        got = {(r.i, r.j) for r in similarity.similar_pairs(v, 0.7, 5, True, size=size).collect()}
        assert got == {(0, 1), (2, 3)}
        assert {r.id: r.degree for r in similarity.degrees(v, 0.5, size).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0}
    many = vectors(spark, [[1.0, 0.0]] * 9)
    edges = similarity.similar_pairs(many, 0.7, 5, True, size=4).collect()
    assert sorted((r.i, r.j) for r in edges if r.i == 0) == [(0, j) for j in range(1, 6)]
    ranks = similarity.degree_rank(spark.createDataFrame([(0,), (1,), (2,), (3,)], "id long"), spark.createDataFrame([(0, 1), (0, 2)], "i long, j long"))
    assert {r.id: r["rank"] for r in ranks.collect()} == {0: 0.5, 1: 0.25, 2: 0.25, 3: 0.0}
    assert similarity.centroid_and_uniqueness(vectors(spark, [[1.0, 0.0]])).first().uniqueness == 0.0
    assert similarity.neighbors(vectors(spark, [])).count() == 0 and similarity.centroid_and_uniqueness(vectors(spark, [])).count() == 0


def test_spread_and_worthy(spark):
    rows = spark.createDataFrame([(k, p) for k, p in enumerate("aabc")], "chunk_seq long, path string")
    assert [r.chunk_seq for r in scoring.spread(rows, 3).collect()] == [0, 2, 3]
    scored = spark.createDataFrame([(0, 0.7, True), (1, 0.2, False)], "chunk_seq long, score double, doc_worthy boolean")
    assert scoring.worthy_or_all(scored).count() == 1 and scoring.worthy_or_all(scored.where("chunk_seq = 1")).count() == 1
    assert scoring.worthy(scored, 0.0).count() == 2
    empty = scoring.score_statistics(scored.where("false")).first()
    assert empty.n == 0 and empty.percent_worthy is None


def test_exchange(spark):
    asked = spark.createDataFrame([(1, "a" * 8), (2, "b"), (3, "c")], "symbol_id long, text string")
    told = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (9, 0, "z")], "symbol_id long, seq int, answer string")
    assert sorted(r[0] for r in batching.missing(asked, told).collect()) == [2, 3]
    assert {r.symbol_id: (r.answer, r.success) for r in batching.matched(asked, told).collect()} == {1: ("y", True), 2: (None, False), 3: (None, False)}


def test_routing(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p] or [], "path string")
    code = lambda f: f.agg(CodeIngestor().detect().alias("x")).first()[0]
    assert code(paths(*[f"{k}.py" for k in range(3)], *[f"{k}.bin" for k in range(7)])) is False
    assert code(paths("a/b/Makefile", "x.txt", "y.txt", "z.txt")) and code(paths("x.csproj", "a", "b", "c")) and not code(paths())
    r = default_registry()
    assert r.names() == ["code", "generic_text"] and r.domain(paths("a.txt")) == "generic" and r.select(paths("a.txt"), "code").name == "code"
    assert r.select(paths("a.png")).name == "generic_text"
    r.unregister("generic_text")
    with pytest.raises(ValueError):
        r.select(paths("a.png"))
    assert isinstance(TextIngestor().detect(), type(F.lit(1)))


@pytest.fixture
def project(tmp_path):
    top = tmp_path / "proj"
    for name, text in {"setup.py": "x = 1\n" * 30, "src/a.py": "def f(a):\n    if a and a: return 1\n", "src/b.rs": "pub fn g() {}\n", "docs/n.md": "# T\n" + "word " * 40, ".git/x": "no", "node_modules/m.js": "function no() {}", "é.txt": "é" * 300}.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    (top / "big.txt").write_bytes(b"x" * 1_000_001)
    (top / "ok.txt").write_bytes(b"y" * 1_000_000)
    (top / "latin.txt").write_bytes("caf\xe9 ".encode("latin-1") * 40)
    return top


def test_sources(spark, project, tmp_path):
    got = {r.path: r for r in fs.read_directory(spark, str(project)).collect()}
    assert set(got) == {"setup.py", "src/a.py", "src/b.rs", "docs/n.md", "é.txt", "ok.txt", "latin.txt"} or len(got) == 7
    texts = {r.path: r.text for r in fs.decoded(fs.read_directory(spark, str(project))).collect()}
    assert texts["latin.txt"].startswith("café")
    import shutil

    name = shutil.make_archive(str(tmp_path / "p"), "zip", tmp_path, "proj")
    zipped = {r.path for r in fs.read_source(spark, name).collect()}
    assert zipped >= {"setup.py", "src/a.py"} and ".git/x" not in zipped
    with pytest.raises(ValueError):
        fs.read_source(spark, "https://example.com/a/b")
    tree = fs.tree(fs.read_zip(spark, name)).orderBy(*fs.tree_order()).collect()
    assert [r.name for r in tree if r.parent_path == ""][:2] == ["docs", "src"]
    assert one(spark, S.archive_url(F.lit("https://x.example/o/r.git/"))) == "https://github.com/o/r/archive/refs/heads/main.zip"


def test_build_and_pack(spark, project, tmp_path):
    config = Config(str(project), edge_threshold=0.1)
    result = build(spark, config, generator=documents.EchoGenerator())
    assert result.ingestor == "code" and result.usage.first().n_failed == 0 and result.docs.count() > 0
    seqs = sorted(r[0] for r in result.chunks.select("chunk_seq").collect())
    assert seqs == list(range(len(seqs)))
    scores = [r[0] for r in result.scored.select("score").collect()]
    assert all(0 <= s <= 1 for s in scores) and len(scores) == len(seqs)
    path = write(build(spark, config), config, str(tmp_path / "o.docpack"))
    info = pack.pack_info(path)
    assert list(info["members"]) == list(pack.MEMBERS) and info["manifest"]["total_chunks"] == len(seqs) and info["members"]["embeddings.bin"] == 4 * 384 * len(seqs)
    pack.extract_pack(path, str(tmp_path / "x"))
    back = fs.read_embeddings(spark, str(tmp_path / "x/embeddings.bin"), 384, len(seqs))
    assert back.count() == len(seqs)
    with pytest.raises(Exception, match="not rows"):
        fs.read_embeddings(spark, str(tmp_path / "x/embeddings.bin"), 383).count()
    text = build(spark, Config(str(project), ingestor="generic_text"))
    assert text.domain == "generic" and text.docs.count() > 0


def test_generator_retries(spark):
    class Picky:
        def generate(self, prompts):
            return [{"text": "{}", "input_tokens": 1, "cached_tokens": 0, "output_tokens": 1, "success": len(p) < 100, "error": None if len(p) < 100 else "long"} for p in prompts]

    asked = spark.createDataFrame([(1, "a" * 100), (2, "b"), (3, "c" * 1000)], "chunk_seq long, prompt string")
    got = {r.chunk_seq: r.success for r in documents.generated(asked, Picky(), 2).collect()}
    assert got == {1: True, 2: True, 3: False}


@pytest.fixture(scope="module")
def short_texts(spark, tmp_path_factory):
    """Documents whose text is shorter than the number before it in the prompt."""
    folder = tmp_path_factory.mktemp("short")
    rows = [(100000, "b c", "en", "web"), (200005, "a", "en", "web"), (300007, None, "de", "web"), (1234560, None, "de", "wiki"), (12345678905, "", "en", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_documentation_rows_of_short_texts(spark, short_texts):
    from marlstone.plan_queries import documentation_rows

    assert [tuple(r) for r in documentation_rows(spark, short_texts).collect()] == [("doc_300007", "s300007")]


def test_failure_report_of_short_texts(spark, short_texts):
    from marlstone.plan_queries import failure_report

    got = {r.path: r.error for r in failure_report(spark, short_texts).collect()}
    assert got == {"web/en/100000.txt": "refused 100000", "web/en/200005.txt": "refused 200005", "wiki/de/1234560.txt": "refused 1234560", "web/en/12345678905.txt": "refused 12345678905"}


def test_generation_totals_of_short_texts(spark, short_texts):
    from marlstone.plan_queries import generation_totals

    r = generation_totals(spark, short_texts).first()
    assert (r.n, r.n_ok, r.n_failed, r.input_tokens) == (5, 1, 4, 500)


def test_run_statistics_of_short_texts(spark, short_texts):
    from marlstone.plan_queries import run_statistics

    r = run_statistics(spark, short_texts).first()
    assert (r.total_files, r.total_chunks, r.llm_docs_generated) == (3, 5, 1)


@pytest.fixture(scope="module")
def without_doc_id(spark, tmp_path_factory):
    """Documents of which one has no doc_id, so that there is nothing to ask."""
    folder = tmp_path_factory.mktemp("without")
    rows = [(None, "a b", "en", "web"), (10, None, "en", "web"), (11, "c", "en", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_failure_report_without_doc_id(spark, without_doc_id):
    from marlstone.plan_queries import failure_report

    assert [tuple(r) for r in failure_report(spark, without_doc_id).collect()] == [("web/en/10.txt", "refused 10")]


def test_generation_totals_without_doc_id(spark, without_doc_id):
    from marlstone.plan_queries import generation_totals

    r = generation_totals(spark, without_doc_id).first()
    assert (r.n, r.n_ok, r.n_failed) == (3, 1, 1)


def test_run_statistics_without_doc_id(spark, without_doc_id):
    from marlstone.plan_queries import run_statistics

    assert run_statistics(spark, without_doc_id).first().llm_docs_generated == 1


def test_stream(spark, tmp_path):
    from marlstone.streaming.budget import admitted, chunk_stream

    second = 1_000_000
    told, held = admitted([(0, 60), (10 * second, 50), (20 * second, 500)], [], 100, 60 * second)
    assert [t[2] // second for t in told] == [0, 60, 120] and len(held) == 1
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("t" * 500)
    q = chunk_stream(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("chunks").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("chunks").count() == 3


def test_sums_before(spark):
    from marlstone.operators.order import sums_before

    for n in (0, 1, 7, 9000):
        rows = spark.range(n).selectExpr("concat('a/', id * 7919 % 10007) AS k", "id % 5 AS n")
        got = {r.k: r.before for r in sums_before(rows, "k", "n").collect()}
        want, total = {}, 0
        for k, v in sorted((f"a/{i * 7919 % 10007}", i % 5) for i in range(n)):
            want[k], total = total, total + v
        assert got == want


def test_neighbors_by_any_block_size_and_with_ties(spark):
    import numpy as np

    x = np.random.default_rng(3).integers(-1, 2, (60, 4)).astype(float)
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, embedding array<double>")
    length = np.linalg.norm(x, axis=1, keepdims=True)
    s = (u := x / np.where(length == 0, 1, length)) @ u.T
    found = {}
    for size in (None, 1, 7, 60):
        rows = similarity.similar_pairs(v, None, 3, False, size=size).collect()
        assert all(abs(s[r.i, r.j] - r.score) < 1e-9 and r.i != r.j for r in rows)
        per = {i: sorted((round(r.score, 9) for r in rows if r.i == i), reverse=True) for i in range(60)}
        assert per == {i: sorted((round(s[i, j], 9) for j in range(60) if j != i), reverse=True)[:3] for i in range(60)}
        found[size] = per
    assert len(set(map(str, found.values()))) == 1


def test_embedding_parts(spark, tmp_path):
    v = spark.range(300).selectExpr("id AS chunk_seq", "array(float(id), float(id) / 2) AS embedding")
    fs.write_embedding_parts(v.repartition(7), f"file://{tmp_path}/e")
    assert sorted(map(tuple, fs.read_embedding_parts(spark, f"file://{tmp_path}/e", 2).collect())) == [(k, [k, k / 2]) for k in range(300)]
