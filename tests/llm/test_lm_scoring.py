import math
import re
from collections import Counter

import pytest

from marlstone.llm.lm_scoring import backoff_scores

from .fixtures import by_id, documents, texts


def brute(docs, order, backoff=0.4):
    words = {i: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in docs}
    grams = {i: Counter(tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1)) for i, w in words.items()}
    every = sum(grams.values(), Counter())
    total = sum(map(len, words.values()))
    out = {}
    for i, w in words.items():
        rest, n = {g: every[g] - c for g, c in grams[i].items()}, total - len(w)

        def p(g):
            if len(g) == 1:
                return rest[g] / n if rest[g] else backoff / (n + 1)  # noqa: B023
            return rest[g] / rest[g[:-1]] if rest[g] else backoff * p(g[1:])  # noqa: B023

        out[i] = (len(w), sum(math.log(p(tuple(w[max(0, k - order + 1) : k + 1]))) for k in range(len(w))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, order):
    docs = list(enumerate(texts()))
    got = by_id(backoff_scores(documents(spark), order))
    for i, (n, s) in brute(docs, order).items():
        assert got[i].n_words == n and got[i].log_score == pytest.approx(s), i
        assert (got[i].mean_log_score is None) == (n == 0)


def test_edges(spark):
    assert backoff_scores(documents(spark, [])).count() == 0
    rows = backoff_scores(documents(spark, [(1, "a b"), (1, "a b"), (None, None)])).collect()
    assert sorted((r.n_words, round(r.log_score, 6)) for r in rows) == [(0, 0.0), (2, round(math.log(0.5), 6)), (2, round(math.log(0.5), 6))]


def test_query_uses_contexts_of_two_words(spark, tmp_path):
    from marlstone.llm.queries import op9_lm_scoring

    docs = [(1, "a b c"), (2, "a b c"), (3, "x b d"), (4, "a b d y")]
    documents(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got, want = by_id(op9_lm_scoring(spark, str(tmp_path))), brute(docs, 3)
    assert all(got[i].log_score == pytest.approx(s) for i, (_, s) in want.items())
    assert any(abs(s - brute(docs, 2)[i][1]) > 0.01 for i, (_, s) in want.items())


def test_keys_travel_whole():
    import numpy as np

    from marlstone.llm.lookup import _unwired, _wired, cuts_of

    rng = np.random.default_rng(5)
    for n in (0, 1, 300, 20_000):
        for bits in (6, 11, 16):
            keys = np.unique(np.r_[rng.integers(0, 1 << 64, n, np.uint64), np.array([0, 1, (1 << 64) - 1], np.uint64)])
            _, cut = cuts_of(keys, bits)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                assert (_unwired(_wired(keys[a:b], bits)) == (keys[a:b] << np.uint64(bits)) >> np.uint64(16)).all()
