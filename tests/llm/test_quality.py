import random
import re

import numpy as np

from marlstone.llm.cotraining import classify, fit
from marlstone.llm.quality_rules import quality

from .fixtures import by_id, documents, prose, texts

SYMBOLS = set("#*$%&|<>")


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def base(t):
    w = words(t)
    at = {}
    for k in range(len(w) - 7):
        at.setdefault(tuple(w[k : k + 8]), []).append(k)
    again = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in SYMBOLS for c in t or ""), len(lines) - len(set(lines)), len(again), n < 20 or 100 * len(again) > 30 * n)


def test_rules(spark):
    rng = random.Random(2)
    good = "\n".join(prose(rng, 40).replace("\n", " ") + "." for _ in range(5))
    junk = "\n".join(["Home | News | Shop | Us", "All rights reserved.", "that*** is$$$ not%%% fine***", "LOUD!! TEXT!! ALL!! DAY!!"] * 6)
    docs = list(enumerate([*texts(), good, junk, good + "\n" + junk[:60], "\n".join([good] * 2), "x" * 200_000, "a b c d e f g h " * 3 + good]))
    got = by_id(quality(documents(spark, docs)))
    for i, t in docs:
        assert tuple(got[i])[1:7] == base(t), i
    n = len(docs)
    assert got[n - 6].kept and not got[n - 5].kept and got[n - 4].kept and got[n - 4].cleaned == good
    assert got[0].cleaned is None and got[1].cleaned == "" and got[0].base_failed
    assert quality(documents(spark, [])).count() == 0
    assert quality(documents(spark, [(1, good), (1, good), (None, good)])).where("kept").count() == 3


def labelled(spark, n=400):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        q, bad = int(rng.random() < 0.7), int(rng.random() < 0.2)
        t = prose(rng, 80)
        if not q:
            t = re.sub(r"(\w) ", r"\1*** ", t)
        if bad:
            t = t.replace(" ", " grobian ", 2)
        docs.append((i, t))
        if i % 2:
            labels.append((i, q, bad, "x"))
    return docs, labels


def test_classifier_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = by_id(classify(documents(spark, docs), rows, most_labelled=150))
    known = {i for i, *_ in labels}
    ok = [(got[i].quality_score >= 0.5) == ("***" not in t) and (got[i].toxic_score >= 0.5) == ("grobian" in t) for i, t in docs if i not in known]
    assert np.mean(ok) > 0.95
    assert all(r.accepted == (r.quality_score >= 0.5 and r.toxic_score < 0.5) for r in got.values())
    views = fit(documents(spark, docs), rows)
    assert views["quality"].both[0] > 0


def test_classifier_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = classify(documents(spark), none).collect()
    assert len(rows) == len(texts()) and {r.quality_score for r in rows} == {0.5} and all(r.accepted for r in rows)
    odd = spark.createDataFrame([(1, None, None), (None, 1, 0), (999, 1, 1), (10, 1, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r.accepted for r in classify(documents(spark), odd).collect())
    assert classify(documents(spark, []), odd).count() == 0
    assert classify(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string"), none).count() == 3
