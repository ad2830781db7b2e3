import random

import corpus_pipeline as cp
import pytest

from .fixtures import CLASH, documents, prose
from .test_decontamination import brute as contaminated
from .test_ids import crc
from .test_quality import labelled
from .test_suffix_dedup import brute as repeated


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("corpus")
    docs, labels = labelled(spark, 600)
    rng = random.Random(4)
    passage, bench = prose(rng, 70), prose(rng, 40)
    n = len(docs)
    docs += [(n, docs[0][1]), (n + 1, docs[0][1] + " End"), (n + 2, None), (n + 3, ""), (n + 4, prose(rng, 30) + passage), (n + 5, passage + prose(rng, 50)), (n + 6, prose(rng, 90) + "\n" + bench), (n + 7, passage[:400])]
    documents(spark, docs).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return str(home)


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or {" ".join(w)}


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages_one_by_one(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = dict(cp.STAGES)
    one = cp.settle(kept["quality classifier"](spark, docs, corpus), "t1")
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {i for i, t in rows.items() if i < 600 and "***" not in t and "grobian" not in t}
    got = set(ids(one))
    assert len(good - got) <= 0.03 * len(good) and len([i for i in got if i < 600 and i not in good]) <= 4
    two = cp.settle(kept["simhash near-dedup"](spark, one, corpus), "t2")
    sets = {i: shingles(rows[i]) for i in got}
    alike = lambda a, b: len(a & b) / len(a | b)
    dropped = got - set(ids(two))
    assert set(ids(two)) <= got and dropped
    # Each dropped document is about 0.8 alike to another one, and no two that stay are clearly more alike.
    assert all(max(alike(sets[i], sets[j]) for j in got if j != i) >= 0.7 for i in dropped)
    stay = sorted(set(ids(two)))
    assert all(alike(sets[i], sets[j]) < 0.88 for i in stay for j in stay if i < j)
    assert {600, 601} <= dropped and 0 in stay
    root = {i: i for i in stay}
    three = cp.settle(kept["suffix-array dedup"](spark, two, corpus), "t3")
    want = repeated([(i, rows[i]) for i in set(root.values())])
    texts = {r.doc_id: r.text for r in three.collect()}
    assert set(texts) == {i for i, w in want.items() if w[1] == 0 or w[1] < w[0]}
    assert all(len((texts[i] or "").encode()) == w[0] - w[1] for i, w in want.items() if i in texts)
    four = cp.settle(kept["benchmark decontamination"](spark, three, corpus), "t4")
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    clean = {i for i, w in contaminated(list(texts.items()), bench).items() if not w[4]}
    assert set(ids(four)) == clean and len(clean) < len(texts)
    last = {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in kept["best-fit packing"](spark, four, corpus).collect()}
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain = {i: [*t.encode(texts[i] or "", add_special_tokens=False).ids, 0] for i in clean}
    assert last == {(i, k // 2048): (len(x[k : k + 2048]), crc(x[k : k + 2048])) for i, x in plain.items() for k in range(0, len(x), 2048)}
    assert {c.name for c in four.schema} == set(cp.COLUMNS) and not set(CLASH) & set(four.columns)
    whole = {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in cp.run(spark, corpus).collect()}
    assert whole == last


def test_stages_on_odd_rows(spark, corpus):
    empty = spark.read.parquet(f"{corpus}/documents.parquet").where("false")
    odd = documents(spark, [(1, "a b"), (1, "a b"), (None, "c d"), (None, None), (5, "x" * 120), (6, "x" * 120 + "yy"), (6, "x" * 120)])
    for name, stage in cp.STAGES:
        assert stage(spark, empty, corpus).count() == 0, name
        assert stage(spark, odd, corpus).count() > 0, name
    deduped = dict(cp.STAGES)["suffix-array dedup"](spark, odd, corpus).collect()
    assert sorted((r.doc_id or -1, len(r.text or "")) for r in deduped) == [(-1, 0), (-1, 3), (1, 3), (1, 3), (5, 120), (6, 2)]
    near = dict(cp.STAGES)["simhash near-dedup"](spark, odd, corpus)
    assert near.where("doc_id = 1").count() == 1 and near.where("doc_id IS NULL").count() == 2


def test_workers_let_go_of_tokenizers():
    import public_tokenizers

    from marlstone.llm import tokens
    from marlstone.llm.common import lean

    path = public_tokenizers.path("word_bpe_49k.json")
    tokens.tokenizer(path)
    assert list(lean(lambda batches: iter(batches), tokens=True)([1, 2])) == [1, 2] and path in tokens._loaded
    assert list(lean(lambda batches: iter(batches))([1])) == [1] and not tokens._loaded


def test_stages_give_back_the_drivers_memory(spark, corpus, monkeypatch):
    from marlstone.llm import common

    trimmed = []
    trim = common.trim_jvm
    monkeypatch.setattr(common, "trim_jvm", lambda s: trimmed.append(trim(s)))
    empty = spark.read.parquet(f"{corpus}/documents.parquet").where("false")
    dict(cp.STAGES)["simhash near-dedup"](spark, empty, corpus)
    # At its beginning, before each of its five parts that tie texts, and at its end.
    assert len(trimmed) >= 7 and all(trimmed)
