import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from marlstone import queries as own

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    cell = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = own.queries()[name](spark, DATA)
    got = duck.execute(own.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.collect(), df.columns) == plain(got.fetchall(), names)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(own.queries()) - set(own.oracle_sql())))
def test_gives_rows(spark, name):
    assert own.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert set(own.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("linked", [False, True])
def test_stands_without_the_optional_part(tmp_path, linked):
    top = Path(entry.__file__).parent
    for p in ("__spark_entry__.py", "marlstone", "corpus_pipeline.py")[: 3 if linked else 2]:
        (tmp_path / p).symlink_to(top / p)
    code = "import sys\nclass No:\n    def find_spec(self, name, *a):\n        if name == 'marlstone.llm' or name.startswith('marlstone.llm.'): raise ModuleNotFoundError(name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nprint(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=False)
    assert out.stdout.strip() == str(len(own.queries())), out.stderr


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
def test_batches_hold_whole_texts(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("text IS NOT NULL").collect()]
    rows = own.queries()["batch_texts"](spark, DATA).collect()
    parts = len(texts) - len(rows)
    assert sum(len(r.batch_text) for r in rows) == sum(map(len, texts)) + parts * len("\n---\n") and max(map(len, texts)) > 50


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["paragraph_chunks", "markdown_sections", "line_chunks", "long_text_chunks"])
def test_chunks_cover_all_documents(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("text RLIKE '[^ \\t-\\r]'").count()
    assert own.queries()[name](spark, DATA).select("path").distinct().count() >= 0.95 * docs
