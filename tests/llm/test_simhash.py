import random
import re

import numpy as np
from xxhash import xxh64_intdigest

from marlstone.llm.simhash import _join_nodes, near_duplicates, similar_groups

from .fixtures import by_id, documents, texts


def fingerprint(text, n=3):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(docs):
    fp = {i: fingerprint(t) for i, t in docs}
    root = {i: i for i in fp}
    for i in fp:
        for j in fp:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 3 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return {i: (f"{fp[i]:016x}", root[i]) for i in fp}


def test_near_duplicates(spark):
    docs = list(enumerate(texts()))
    got = by_id(near_duplicates(documents(spark), shingle=3))
    want = brute(docs)
    assert {i: tuple(r)[1:] for i, r in got.items()} == want
    assert len({w[1] for w in want.values()}) < len(want) - 4
    assert near_duplicates(documents(spark, []), shingle=3).count() == 0
    rows = near_duplicates(documents(spark, [(5, "a b c d"), (5, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "q r s t")]), shingle=3).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (-1, 2), (2, 2), (5, 2), (5, 2)]


def test_trie_pairs_equal_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    keys = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6))]))
    near = lambda i, j: np.bitwise_count(keys[i] ^ keys[j]) <= 3
    joined = lambda owner: sorted((int(i), int(j)) for a, b in _join_nodes(keys, np.array([0]), np.array([len(keys)]), 64, np.full(65, 3), near, owner, chunk=64) for i, j in zip(a, b, strict=True))
    got = joined(None)
    want = [(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if int(keys[i] ^ keys[j]).bit_count() <= 3]
    assert got == want and want
    owner = rng.integers(0, 3, len(keys))
    assert joined(owner) == [(i, j) for i, j in want if owner[i] != owner[j]]
    assert joined(np.zeros(len(keys), np.int64)) == []


def test_recall_of_planted_near_copies(spark):
    """Copies at 0.8, 0.85 and 0.9, of texts of all lengths: all are found, though only signatures within the budget are compared."""
    rng = random.Random(21)
    words, docs, want = [f"w{k}" for k in range(5000)], [], {0.8: 0, 0.85: 0, 0.9: 0}
    for k in range(240):
        n = rng.choice([30, 60, 150, 400, 900])
        base, least = [rng.choice(words) for _ in range(n)], rng.choice(sorted(want))
        copy = list(base)
        sets = lambda x: {tuple(x[j : j + 5]) for j in range(len(x) - 4)}
        own = sets(base)
        for _ in range(n):
            other = list(copy)
            other[rng.randrange(len(other))] = rng.choice(words)
            if len(own & sets(other)) / len(own | sets(other)) < least:
                break
            copy = other
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        want[least] += 1
    got = {r.doc_id: r.component_id for r in similar_groups(documents(spark, docs)).collect()}
    assert all(n > 40 for n in want.values()) and all(got[2 * k] == got[2 * k + 1] == 2 * k for k in range(240))


def test_similar_groups_find_near_copies(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    docs, pairs = [], []
    for k in range(60):
        base = [rng.choice(words) for _ in range(250)]
        docs.append((2 * k, " ".join(base)))
        copy = list(base)
        for _ in range([1, 2, 4, 12, 40][k % 5]):
            copy[rng.randrange(250)] = rng.choice(words)
        docs.append((2 * k + 1, " ".join(copy)))
        a, b = ({" ".join(x[j : j + 5]) for j in range(246)} for x in (base, copy))
        pairs.append(len(a & b) / len(a | b))
    got = {r.doc_id: r.component_id for r in similar_groups(documents(spark, docs)).collect()}
    together = [got[2 * k] == got[2 * k + 1] for k in range(60)]
    assert all(t for t, s in zip(together, pairs, strict=True) if s >= 0.87) and not any(t for t, s in zip(together, pairs, strict=True) if s <= 0.7)
    assert all(got[i] in (i, i - i % 2) for i in got)


def test_similar_groups_are_exact_components(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(4000)]
    notice = [rng.choice(words) for _ in range(60)]
    docs = [(1, "a b c"), (2, "A b  c"), (3, "a b d"), (4, None), (5, " "), (6, "a b c d e f g h"), (7, "a b c d e f g h i"), (8, "a b c d e f g")]
    for k in range(150):
        base = [rng.choice(words) for _ in range([9, 14, 40, 120, 400][k % 5])] + (notice if k % 3 == 0 else [])
        docs.append((100 + 4 * k, " ".join(base)))
        for c in range(1, 3):
            copy = list(base)
            for _ in range(max(1, round(len(base) * rng.uniform(0.01, 0.035)))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            cut = rng.randrange(1 + len(copy) // 5)
            docs.append((100 + 4 * k + c, " ".join(copy[: len(copy) - cut] if c == 2 else copy)))
    # 41 and 51 shingles, all but 10 of the longer one in common, and one less: above and below 0.8.
    run = [f"r{k}" for k in range(54)]
    docs += [(2000, " ".join(run)), (2001, " ".join(run[:44])), (2002, " ".join(f"s{k}" for k in range(54))), (2003, " ".join(f"s{k}" for k in range(43)))]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in ((i, (t or "").lower().split()) for i, t in docs)}
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    root = {i: i for i in sets}
    for (i, j), s in alike.items():
        if s >= 0.8 and root[i] != root[j]:
            a, b = sorted((root[i], root[j]))
            root = {k: a if r == b else r for k, r in root.items()}
    assert sum(0.8 <= s < 0.85 for s in alike.values()) > 15 and sum(0.7 < s < 0.8 for s in alike.values()) > 15 and (0.8 in alike.values())
    got = {r.doc_id: r.component_id for r in similar_groups(documents(spark, docs)).collect()}
    assert got == root
