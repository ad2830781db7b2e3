import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm.fmindex import FMIndex, contamination

from .fixtures import by_id, documents, texts

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    wins = {}
    for name, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k : k + 13]), set()).add(name)
    out = {}
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if own := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= own
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_contamination(spark):
    all_texts = texts()
    pick = [words(all_texts[k]) for k in (30, 31, 33, 40, 41)]
    items = [("0", " ".join(pick[0][:40])), ("1", " ".join(pick[1][5:30])), ("2", all_texts[12]), ("10", "A b"), ("3", None), ("4", "?!"), ("5", " ".join(pick[4][2:15])), ("6", "zz zz zz"), ("7", "never seen words")]
    docs = list(enumerate(all_texts))
    for block in (4 << 20, 100):
        bench = spark.createDataFrame([(int(a), b, "x") for a, b in items], "item_id long, text string, spans string")
        got = by_id(contamination(documents(spark), bench, block_bytes=block))
        want = brute(docs, items)
        assert {i: tuple(r)[1:6] for i, r in got.items()} == want
    assert sum(w[4] for w in want.values()) >= 3
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in contamination(documents(spark), empty).collect()} == {0}
    assert contamination(documents(spark, []), bench).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.lists(st.integers(1, 5), min_size=1, max_size=4))
def test_index_finds_all(x, p):
    index = FMIndex(np.array(x, np.int64))
    lo, hi = index.search(np.array([p], np.int64))
    found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
    assert found == [k for k in range(len(x) - len(p) + 1) if x[k : k + len(p)] == p]
