import hashlib
import re
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm.suffix_dedup import _repeats, _repeats_of_all, deep_shallow_sort, repeated_spans

from .fixtures import by_id, documents, texts


def brute(docs, length=50):
    first, out = {}, {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, i), i)
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_spans(spark):
    docs = list(enumerate(texts()))
    docs += [(len(docs), docs[20][1][5:70]), (len(docs) + 1, "é" * 300), (len(docs) + 2, docs[15][1]), (len(docs) + 3, docs[16][1])]
    got = by_id(repeated_spans(documents(spark, docs)))
    want = brute(docs)
    assert {i: tuple(r)[1:5] for i, r in got.items()} == want
    assert sum(w[1] > 0 for w in want.values()) >= 6
    assert repeated_spans(documents(spark, [])).count() == 0
    t = docs[20][1]
    rows = repeated_spans(documents(spark, [(3, t), (3, t), (None, "x"), (9, t + "é")]), text_too=True).collect()
    assert sorted((r.doc_id or -1, r.n_removed, r.kept == t) for r in rows) == [(-1, 0, False), (3, 0, True), (3, 0, True), (9, len(t.encode()), False)]
    assert [r.kept for r in rows if r.doc_id == 9] == ["é"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"ab" * 30, b"a" * 60, b"b" * 70, b"xyz" * 25, b"ab" * 24 + b"q" * 12, b"\xff\x00" * 33]), max_size=8), st.binary(min_size=60, max_size=90))
def test_sort(parts, tail):
    raw = b"".join([*parts, tail])
    starts = np.arange(len(raw) - 49)
    order, group = deep_shallow_sort(np.frombuffer(raw + bytes(66), np.uint8), starts, 50)
    got = [raw[k : k + 50] for k in starts[order]]
    assert got == sorted(got)
    assert [a == b for a, b in zip(got, got[1:], strict=False)] == (np.diff(group) == 0).tolist()


def test_copies_of_segments_are_sorted_once():
    rng = np.random.default_rng(5)
    base = rng.integers(97, 100, 400).astype(np.uint8).tobytes()
    parts = [base[k : k + 63] for k in range(0, 300, 7)]
    number, least = rng.integers(0, len(parts), 8000), rng.integers(0, 50, 8000)
    peaks, told = [], []
    for f in (lambda: _repeats([parts[k] for k in number], least, 50), lambda: _repeats_of_all(parts, number, least, 50)):
        tracemalloc.start()
        told.append(f())
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert np.array_equal(told[0] & np.uint64((1 << 14) - 1), told[1] & np.uint64((1 << 14) - 1))
    assert peaks[1] * 10 < peaks[0]
