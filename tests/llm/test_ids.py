import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.types import ArrayType, BinaryType
from tokenizers import Tokenizer

from marlstone.llm import token_files
from marlstone.llm.idcodec import BLOCK, _earlier, _Seen, decode, encode
from marlstone.llm.jvm import register
from marlstone.llm.packing import pack, sum_of_squares
from marlstone.llm.token_files import read_token_files, segment_ids, token_file_index, write_token_files
from marlstone.llm.tokens import WordTokenizer, tokenizer

from .fixtures import by_id, documents, texts

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(end):
    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts()]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 5)), min_size=1, max_size=300), max_size=5))
def test_codec_round_trip(blocks):
    blocks = [np.array(b, np.uint32) for b in blocks]
    assert all(np.array_equal(a, b) for a, b in zip(decode(encode(blocks)), blocks, strict=True))


def test_codec_full_blocks_and_damage():
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 65536, BLOCK).astype(np.uint32), np.arange(BLOCK, dtype=np.uint32), np.zeros(BLOCK, np.uint32), (rng.zipf(1.3, BLOCK) % 49408).astype(np.uint32)]
    coded = encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(decode(coded), blocks, strict=True))
    assert len(coded[2]) < 100 and len(coded[3]) < 2 * BLOCK
    assert np.array_equal(decode([coded[1]])[0], blocks[1])  # blocks stand alone
    bad = bytearray(coded[3])
    bad[len(bad) // 2] ^= 1
    with pytest.raises(ValueError):
        decode([bytes(bad)])
    with pytest.raises(ValueError):
        decode([coded[3][:-2]])


def test_codec_bytes_stay():
    blocks = [(np.arange(n, dtype=np.int64) * n * 7919 % 97 * (np.arange(n) % 5) + np.arange(n) // 300 * 11).astype(np.uint32) for n in (BLOCK, 700, 1)]
    assert [zlib.crc32(c) for c in encode(blocks)] == [1666123691, 45857111, 2937749167]  # files written before stay readable


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=500))
def test_earlier_ranks(ranks):
    below, same = _earlier(np.array(ranks))
    assert below.tolist() == [sum(r < x for r in ranks[:k]) for k, x in enumerate(ranks)] and same.tolist() == [ranks[:k].count(x) for k, x in enumerate(ranks)]


def test_seen_finds_shares():
    rng = np.random.default_rng(7)
    seen, had = _Seen(3, (5, 4, 4)), np.zeros((3, BLOCK), np.int64)
    for t in range(1, 400):
        r = np.where(rng.random(3) < 0.5, rng.integers(0, 40, 3), rng.integers(0, BLOCK, 3))
        seen.add(3, r)
        had[np.arange(3), r] += 1
        lanes, target = np.array([2, 0, 1]), rng.integers(0, t, 3)
        rank, below, many = seen.find(lanes, target)
        assert (below <= target).all() and (target < below + many).all()
        assert below.tolist() == [had[j, :k].sum() for j, k in zip(lanes, rank, strict=True)] and many.tolist() == had[lanes, rank].tolist()


def test_token_files(spark):
    got = by_id(token_file_index(documents(spark), PATH))
    start = 0
    for i, ids in enumerate(plain_ids(1)):
        assert tuple(got[i])[1:] == (start, len(ids), crc(ids)), i
        start += len(ids)
    assert token_file_index(documents(spark, []), PATH).count() == 0
    twice = [(7, "b c"), (7, "b c"), (None, "x"), (3, None)]
    rows = sorted(map(tuple, token_file_index(documents(spark, twice), PATH).select("start", "n_tokens").collect()))
    assert [r[1] for r in rows] == [2, 1, 3, 3] and [r[0] for r in rows] == [0, 2, 3, 6]
    blocks = write_token_files(documents(spark), PATH).selectExpr("explode(blocks) b").collect()
    assert all(r.b[:4] == b"MIDC" for r in blocks)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abzAZ09 \t\n'.,!*~_|<>-éÉßẞÿŸ×÷µªÅKİǅñ\u0301\u00a0\u200b\x0b\x1f\x7fΣς²½中🙂", max_size=30), min_size=1, max_size=8))
def test_runs_have_the_ids_of_whole_texts(some):
    whole, own = Tokenizer.from_file(PATH), tokenizer(PATH)
    assert own.bare is not own.tokenizer
    ids, counts = own([*some, None, "it's straße l'été " + " ".join(some)])
    want = [whole.encode(x, add_special_tokens=False).ids for x in (*some, "", "it's straße l'été " + " ".join(some))]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]


def test_runs_of_control_characters_shift_nothing():
    text = "\x0b _- |\x0b> _-"
    ids, counts = WordTokenizer(PATH)([text])  # one run without pre-tokens, another with one more than counted
    assert ids.tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]


def segments(spark, blocks_of):
    rows = [(k, bytearray(np.concatenate(b).astype("<u2").tobytes())) for k, b in enumerate(blocks_of)]
    function = register(spark, "IdCodec.java", "marlstone.IdCodec$Blocks", "marlstone_blocks", ArrayType(BinaryType()))
    got = spark.createDataFrame(rows, "k long, ids binary").repartition(3).selectExpr("k", f"{function}(ids) blocks").collect()
    return [[bytes(b) for b in r.blocks] for r in sorted(got)]


def test_jvm_codes_the_same_bytes(spark):
    rng = np.random.default_rng(11)
    kinds = [
        lambda n: rng.integers(0, 65536, n),
        lambda n: rng.zipf(1.2, n) % 49408,
        lambda n: np.arange(n) * 7919 % 97 * (np.arange(n) % 5) + np.arange(n) // 300 * 11,
        lambda n: (rng.random(n) < 0.01) * rng.integers(0, 65536, n),
        lambda n: np.tile(rng.integers(0, 65536, 50), n // 50 + 1)[:n],
        lambda n: rng.permutation(65536)[:n],
    ]
    ids = [kind(n).astype(np.uint32) for n in (1, 2, 700, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK + 5) for kind in kinds]
    blocks = [[x[k : k + BLOCK] for k in range(0, len(x), BLOCK)] for x in ids]
    coded = segments(spark, blocks)
    assert sum(coded, []) == encode(sum(blocks, []))  # all lanes at once
    assert np.array_equal(segment_ids(sum(coded, [])), np.concatenate(ids))


def test_jvm_reads_segments_and_finds_damage(spark):
    ids = (np.random.default_rng(2).zipf(1.3, 3 * BLOCK + 9) % 49408).astype(np.uint32)
    coded = encode([ids[k : k + BLOCK] for k in range(0, len(ids), BLOCK)])
    counts = [1, 5, 2 * BLOCK, 0, len(ids) - 2 * BLOCK - 6]  # a document over several blocks, and one of no ids
    index = np.array([[np.iinfo(np.int64).min, -3, 7, 7, 1 << 40], counts], "<i8").tobytes()

    def read(index, blocks):
        files = spark.createDataFrame([(4, 100, bytearray(index), [bytearray(b) for b in blocks])], "part long, start long, index binary, blocks array<binary>")
        return [tuple(r) for r in read_token_files(files).collect()]

    ends = np.cumsum(counts)
    want = [(d, 4, 100 + int(e - n), n, crc(ids[e - n : e].tolist())) for d, n, e in zip([None, -3, 7, 7, 1 << 40], counts, ends, strict=True)]
    assert read(index, coded) == want
    at = len(coded[1]) // 2
    flipped = coded[1][:at] + bytes([coded[1][at] ^ 1]) + coded[1][at + 1 :]
    for blocks in ([coded[0], flipped, *coded[2:]], [coded[0][:-2], *coded[1:]], [b"", *coded[1:]], coded[:-1], [*coded, coded[0]]):
        with pytest.raises(Exception, match="not a coded block|checksum does not hold|blocks end before|documents end before"):
            read(index, blocks)


def test_segments_end_at_whole_documents(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 3000)
    monkeypatch.setattr(token_files, "DOCUMENTS", 40)
    monkeypatch.setattr(token_files, "slices_by_size", lambda t: [slice(k, k + 1) for k in range(len(t))])
    many = [(k, "a b c" if k < 100 else "word " * 5000 if k == 100 else None if k % 2 else "x" * k) for k in range(150)]
    rows = write_token_files(documents(spark, many), PATH).orderBy("part", "start").collect()
    t = Tokenizer.from_file(PATH)
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for _, x in many]
    assert np.concatenate([segment_ids([bytes(b) for b in r.blocks]) for r in rows]).tolist() == sum(want, [])
    index = [np.frombuffer(r["index"], "<i8").reshape(2, -1) for r in rows]
    assert max(i.shape[1] for i in index) <= 40 and all(i[1].sum() <= 3000 or i.shape[1] == 1 for i in index)
    got = by_id(token_file_index(documents(spark, many), PATH))
    assert [got[k].ids_crc32 for k in range(150)] == [crc(x) for x in want]


def test_blocks_are_coded_in_the_jvm(spark):
    """CPU budget: a step over lanes in numpy took over a microsecond for each id, there and back; Python only cuts texts into ids now."""
    files = write_token_files(documents(spark), PATH)
    plan = read_token_files(files)._jdf.queryExecution().executedPlan().toString()
    assert "marlstone_documents" in plan and "MapInArrow" not in plan


def test_packing(spark):
    got = pack(documents(spark), PATH).collect()
    want = {}
    for i, ids in enumerate(plain_ids(0)):
        for k in range(0, len(ids), 2048):
            want[i, k // 2048] = (k, len(ids[k : k + 2048]), crc(ids[k : k + 2048]))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1
    assert pack(documents(spark, []), PATH).count() == 0
    assert pack(documents(spark, [(1, None), (1, None), (None, "a")]), PATH).count() == 3


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_sum_of_squares_fills_bins(lengths):
    bins, offset = sum_of_squares(np.array(lengths, np.int64), 40)
    used = {}
    for b, o, n in sorted(zip(bins.tolist(), offset.tolist(), lengths, strict=True)):
        assert o == used.get(b, 0)
        used[b] = o + n
    assert all(v <= 40 for v in used.values())
    if lengths:
        assert len(used) <= 2 * -(-sum(lengths) // 40)


def test_blocks_are_dealt_evenly():
    from marlstone.llm.token_files import LANES, lane_slices

    for n in (0, 1, LANES, LANES + 1, 3 * LANES - 5):
        got = [s.stop - s.start for s in lane_slices(n)]
        assert sum(got) == n and len(got) == -(-n // LANES) and (not got or max(got) - min(got) <= 1 and max(got) <= LANES)
