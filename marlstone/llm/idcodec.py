"""Binary output of token ids: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A block holds up to BLOCK ids and is coded on its own. Per id, the order-2 and order-1 contexts each name the id that last
followed them, with a confidence of 0 to 3 for how often in a row it did. One symbol tells which prediction holds:
  0 the order-2 id, 1 the order-1 id, 2 an id that the block has had already, 3 a new id.
Two adaptive distributions of that symbol, one by the order-2 confidence and the symbol before, one by both confidences, are mixed
by a weight that follows whichever predicted better. A known id is then coded by the order-0 model, the adaptive frequencies of
all ids of the block so far; a new id by adaptive frequencies of its high byte, which start from a fixed slope (low ids are the
common ones), and 8 plain bits. A carry-propagating range coder (48-bit low, 16-bit words) does the arithmetic coding. Blocks are
coded side by side, one lane each, so that a step is a few array operations over all lanes; everything is integer arithmetic, so
any machine decodes alike. Within Spark, IdCodec.java does the same id by id in the JVM, with the same bytes; this is the reader
and writer for plain Python.

A coded block: magic "MIDC", uint32 number of ids, uint32 crc32 of the ids (little-endian uint32), uint32 number of words, then
the words (little-endian uint16).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 8192
MAGIC = b"MIDC"
SLOTS = 1 << 13
#: Frequencies of a new id's high byte to begin with.
_HIGH = np.maximum(1, 96 // (1 + np.arange(256))).astype(np.int32)
_SYMBOLS = 4
_ONE = 1 << 15
_TARGET = np.where(np.arange(_SYMBOLS)[None, :] > np.arange(_SYMBOLS)[:, None], _ONE, 0).astype(np.int32)
_START = (np.arange(_SYMBOLS) * (_ONE // _SYMBOLS)).astype(np.int32)
_STEP = np.arange(_SYMBOLS, dtype=np.int32)
_LOW32 = np.uint64(0xFFFFFFFF)


def _slot2(prev: np.ndarray, before: np.ndarray) -> np.ndarray:
    return (prev.astype(np.uint32) * np.uint32(40503) ^ before.astype(np.uint32) * np.uint32(30011)) >> np.uint32(7) & np.uint32(SLOTS - 1)


def _told(slots: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the id that last followed its slot and its state: 0 none, 1 + confidence else."""
    order = np.argsort(slots.astype(np.uint16), kind="stable")
    s, y = slots[order], ids[order]
    n = len(s)
    same = np.zeros(n, bool)
    same[1:] = s[1:] == s[:-1]
    eq = np.zeros(n, bool)
    eq[1:] = same[1:] & (y[1:] == y[:-1])
    guess, state, run = np.zeros(n, np.uint32), same.astype(np.uint8), same.copy()
    guess[1:] = np.where(same[1:], y[:-1], 0)
    for back in (1, 2, 3):
        held = np.zeros(n, bool)
        held[back:] = eq[:-back] if back < n else held[back:]
        run &= held
        state += run
    out, kind = np.empty(n, np.uint32), np.empty(n, np.uint8)
    out[order], kind[order] = guess, state
    return out, kind


def _symbols(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, rank of first appearance, and the states of both contexts for each id of a block."""
    n = len(ids)
    prev, before = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    prev[1:], before[2:] = ids[:-1], ids[:-2]
    guess2, state2 = _told(_slot2(prev, before), ids)
    guess1, state1 = _told(prev & np.uint32(SLOTS - 1), ids)
    first = np.empty(1 << 16, np.int32)
    at = np.arange(n, dtype=np.int32)
    first[ids[::-1]] = at[::-1]
    first_at = first[ids]
    new = first_at == at
    rank = (np.cumsum(new) - new)[first_at]
    symbol = np.where((state2 > 0) & (guess2 == ids), 0, np.where((state1 > 0) & (guess1 == ids), 1, np.where(new, 3, 2)))
    return symbol, rank, state2, state1


class _Mixer:
    """The two adaptive distributions of each lane and the weight between them."""

    def __init__(self, lanes: int) -> None:
        self.a = np.tile(_START, (lanes * 20, 1))
        self.b = np.tile(_START, (lanes * 25, 1))
        self.w = np.full(lanes, _ONE // 2, np.int32)
        self.last = np.full(lanes, _SYMBOLS - 1)
        self.lane = np.arange(lanes)
        self.flat = self.lane * _SYMBOLS

    def mixed(self, state2: np.ndarray, state1: np.ndarray, n: int) -> np.ndarray:
        self.ia, self.ib = self.lane[:n] * 20 + state2 * 4 + self.last[:n], self.lane[:n] * 25 + state2 * 5 + state1
        self.ra, self.rb = self.a.take(self.ia, 0), self.b.take(self.ib, 0)
        w = self.w[:n, None]
        row = (self.rb - self.ra) * 1
        row *= w >> 2
        row >>= 13
        row += self.ra
        row -= row >> 10
        row += _STEP
        return row

    def learn(self, symbol: np.ndarray, n: int) -> None:
        at, top = self.flat[:n] + symbol, symbol == _SYMBOLS - 1
        up = np.minimum(at + 1, _SYMBOLS * n - 1)
        ra, rb = self.ra.ravel(), self.rb.ravel()
        pa_, pb = np.where(top, _ONE, ra[up]) - ra[at], np.where(top, _ONE, rb[up]) - rb[at]
        self.w[:n] += (np.where(pb > pa_, _ONE - 1, 0) - self.w[:n]) >> 5
        target = _TARGET.take(symbol, 0)
        self.a[self.ia] = self.ra + ((target - self.ra) >> 5)
        self.b[self.ib] = self.rb + ((target - self.rb) >> 4)
        self.last[:n] = symbol


#: Places of a block that are compared each with each; the ones before them are counted by rank.
_NEAR = 128
_BEFORE = np.tril(np.ones((_NEAR, _NEAR), bool), -1)


def _earlier(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, how many earlier ones have a lower rank, and how many the same."""
    n, many = len(rank), int(rank.max(initial=0)) + 2
    runs = -(-n // _NEAR)
    padded = np.full(runs * _NEAR, many - 1, np.uint16)
    padded[:n] = rank
    run = np.arange(n) // _NEAR
    had = np.bincount(run * many + rank + 1, minlength=runs * many).astype(np.int32).reshape(runs, many)
    below = np.cumsum(np.cumsum(had, 0) - had, 1, dtype=np.int32).ravel()[run * many + rank]
    short = padded.reshape(runs, _NEAR)
    near = (short[:, None, :] < short[:, :, None]) & _BEFORE
    below = below.astype(np.int64) + _trues(near.reshape(-1, _NEAR))[:n]
    short = padded[:n]
    order = np.argsort(short, kind="stable")
    first = np.flatnonzero(np.r_[True, short[order][1:] != short[order][:-1]])
    same = np.empty(n, np.int64)
    same[order] = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    return below, same


class _Counts:
    """Adaptive frequencies of each lane, with the sums of groups of them level by level; widths are the levels' fan-outs."""

    def __init__(self, lanes: int, widths: tuple[int, ...], start: np.ndarray | None = None) -> None:
        self.widths, self.lane = widths, np.arange(lanes)
        self.levels = []
        for k in range(1, len(widths) + 1):
            n = int(np.prod(widths[:k]))
            row = np.zeros(n, np.int32) if start is None else start.reshape(n, -1).sum(1).astype(np.int32)
            self.levels.append(np.tile(row, (lanes, 1)).reshape(-1, widths[k - 1]))

    def share(self, lanes: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The frequencies of all lower symbols together, and of this one."""
        below, size, n = np.zeros(len(symbol), np.int64), int(np.prod(self.widths)), 1
        for w, level in zip(self.widths, self.levels, strict=True):
            size //= w
            node = symbol // size
            rows = level[lanes * n + node // w]
            below += (rows * (np.arange(w) < (node % w)[:, None])).sum(1)
            n *= w
        return below, rows[np.arange(len(symbol)), symbol % w].astype(np.int64)

    def find(self, lanes: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbol in whose share the target falls, and its share."""
        node, below, n, at = np.zeros(len(target), np.int64), np.zeros(len(target), np.int64), 1, np.arange(len(target))
        for w, level in zip(self.widths, self.levels, strict=True):
            rows = level[lanes * n + node]
            sums = rows.cumsum(1, dtype=np.int32)
            k = np.minimum((sums <= (target - below)[:, None]).sum(1), w - 1)
            own = rows[at, k]
            below = below + sums[at, k] - own
            node, n = node * w + k, n * w
        return node, below, own.astype(np.int64)

    def add(self, lanes: np.ndarray, symbol: np.ndarray, many: int = 1) -> None:
        size, n = int(np.prod(self.widths)), 1
        for w, level in zip(self.widths, self.levels, strict=True):
            size, n = size // w, n * w
            level.ravel()[lanes * n + symbol // size] += many


def _trues(mask: np.ndarray) -> np.ndarray:
    """How many are true in each row of 4 or a multiple of 8."""
    if mask.shape[1] == 4:
        return (mask.view(np.uint32).ravel() * np.uint32(0x01010101) >> np.uint32(24)).astype(np.int64)
    words = mask.view(np.uint64)
    total = words[:, 0]
    for k in range(1, words.shape[1]):
        total = total + words[:, k]
    return (total * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.int64)


class _Seen:
    """How often each rank has been had in each lane, BLOCK times together at most; levels of running sums within nodes, so that
    a search compares and adds nothing up."""

    def __init__(self, lanes: int, bits: tuple[int, ...]) -> None:
        self.bits, self.levels, self.up, n = bits, [], [], 1
        for b in bits:
            self.levels.append(np.zeros((lanes * n, 1 << b), np.int16))
            self.up.append(np.triu(np.ones((1 << b, 1 << b), np.int16)))
            n <<= b

    def find(self, lanes: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rank in whose share the target falls, the shares of all lower ones together, and its share."""
        node, left, at, depth = np.zeros(len(target), np.int64), target.astype(np.int16), np.arange(len(target)), 0
        for b, level in zip(self.bits, self.levels, strict=True):
            rows = level.take((lanes << depth) + node, 0)
            k = np.minimum(_trues(rows <= left[:, None]), (1 << b) - 1)
            here, flat = (at << b) + k, rows.ravel()
            under = np.where(k > 0, flat[here - 1], np.int16(0))
            left = left - under
            node, depth = (node << b) + k, depth + b
        return node, target - left, (flat[here] - under).astype(np.int64)

    def add(self, n: int, symbol: np.ndarray) -> None:
        """One more of a rank in each of the first n lanes."""
        lanes, low, depth = np.arange(n), sum(self.bits), 0
        for b, level, up in zip(self.bits, self.levels, self.up, strict=True):
            low -= b
            node = symbol >> low
            more = up.take(node & ((1 << b) - 1), 0)
            if depth:
                at = (lanes << depth) + (node >> b)
                level[at] = level.take(at, 0) + more
            else:
                level[:n] += more
            depth += b


#: Fan-outs, as powers of two, of the frequencies of known ids; fan-outs of those of a new id's high byte, and what an occurrence of the latter adds.
_KNOWN, _NEW, _MORE = (5, 4, 4), (16, 16), 24


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Coded blocks of uint32 ids below 65536, each of 1 to BLOCK ids."""
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    sizes = np.array([len(blocks[k]) for k in order], np.int64)
    lanes, steps = len(blocks), int(sizes.max(initial=0))
    symbol, share, value = np.zeros((steps, lanes), np.uint8), np.zeros((steps, lanes, 2), np.uint16), np.zeros((steps, lanes), np.uint16)
    state2, state1 = np.zeros((steps, lanes), np.uint8), np.zeros((steps, lanes), np.uint8)
    for j, k in enumerate(order):
        n = len(blocks[k])
        symbol[:n, j], rank, state2[:n, j], state1[:n, j] = _symbols(blocks[k].astype(np.uint32))
        share[:n, j, 0], share[:n, j, 1] = _earlier(rank)
        value[:n, j] = blocks[k]
    out = np.zeros((lanes, 2 * steps + 6), np.uint32)
    words, width, base = out.ravel(), out.shape[1], np.arange(lanes) * out.shape[1]
    low, span, pos = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 48, np.uint64), np.zeros(lanes, np.int64)
    mixer, fresh, total = _Mixer(lanes), _Counts(lanes, _NEW, _HIGH), np.full(lanes, int(_HIGH.sum()), np.uint64)
    live = lanes - np.searchsorted(sizes[::-1], np.arange(steps), side="right")

    def shifted(n: int) -> None:
        k = np.flatnonzero(span[:n] <= _LOW32)
        if len(k):
            part = low[k]
            words[base[k] + pos[k]] = part >> np.uint64(32)
            low[k] = (part & _LOW32) << np.uint64(16)
            span[k] <<= np.uint64(16)
            pos[k] += 1

    for t in range(steps):
        n = int(live[t])
        s = symbol[t, :n].astype(np.int64)
        row = mixer.mixed(state2[t, :n].astype(np.int64), state1[t, :n].astype(np.int64), n).ravel()
        at = mixer.flat[:n] + s
        lo = row[at]
        hi = np.where(s == _SYMBOLS - 1, _ONE, row[np.minimum(at + 1, _SYMBOLS * n - 1)])
        unit = span[:n] >> np.uint64(15)
        low[:n] += unit * lo.astype(np.uint64)
        span[:n] = unit * (hi - lo).astype(np.uint64)
        shifted(n)
        known, new = np.flatnonzero(s == 2), np.flatnonzero(s == 3)
        if len(known):
            unit = span[known] // np.uint64(t)
            low[known] += unit * share[t, known, 0]
            span[known] = unit * share[t, known, 1]
        if len(new):
            ids_ = value[t, new].astype(np.int64)
            below, many = fresh.share(new, ids_ >> 8)
            unit = span[new] // total[new]
            span[new] = unit * many.astype(np.uint64) >> np.uint64(8)
            low[new] += unit * below.astype(np.uint64) + span[new] * (ids_ & 255).astype(np.uint64)
            fresh.add(new, ids_ >> 8, _MORE)
            total[new] += np.uint64(_MORE)
        shifted(n)
        mixer.learn(s, n)
    for shift in (32, 16, 0):
        words[base + pos] = (low >> np.uint64(shift)).astype(np.uint32) if shift == 32 else ((low >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint32)
        pos += 1
    top = int(pos.max(initial=0))
    carry = np.zeros(lanes, np.uint32)
    for j in range(top - 1, -1, -1):
        v = out[:, j] + carry
        out[:, j] = v & np.uint32(0xFFFF)
        carry = v >> np.uint32(16)
    done: list[bytes] = [b""] * lanes
    for j, k in enumerate(order):
        ids = np.ascontiguousarray(blocks[k], "<u4")
        done[k] = MAGIC + struct.pack("<III", len(ids), zlib.crc32(ids.tobytes()), int(pos[j])) + out[j, : pos[j]].astype("<u2").tobytes()
    return done


def decode(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of coded blocks; ValueError where a block is not one, or its checksum does not hold."""
    heads = []
    for c in coded:
        if c[:4] != MAGIC or len(c) < 16 or len(c) != 16 + 2 * struct.unpack("<I", c[12:16])[0]:
            raise ValueError("not a coded block")
        heads.append(struct.unpack("<III", c[4:16]))
    order = sorted(range(len(coded)), key=lambda k: -heads[k][0])
    sizes = np.array([heads[k][0] for k in order], np.int64)
    lanes, steps = len(coded), int(sizes.max(initial=0))
    width = max((h[2] for h in heads), default=0) + 4
    read = np.zeros((lanes, width), np.uint16)
    for j, k in enumerate(order):
        read[j, : heads[k][2]] = np.frombuffer(coded[k], "<u2", offset=16)
    words, base = read.ravel(), np.arange(lanes) * width
    code = (read[:, 0].astype(np.uint64) << np.uint64(32)) | (read[:, 1].astype(np.uint64) << np.uint64(16)) | read[:, 2].astype(np.uint64)
    span, pos = np.full(lanes, 1 << 48, np.uint64), np.full(lanes, 3, np.int64)
    mixer, seen = _Mixer(lanes), _Seen(lanes, _KNOWN)
    fresh, total = _Counts(lanes, _NEW, _HIGH), np.full(lanes, int(_HIGH.sum()), np.uint64)
    ids = np.zeros((steps, lanes), np.uint16)
    known, n_known = np.zeros(lanes * BLOCK, np.uint16), np.zeros(lanes, np.int64)
    # What last followed a context: its rank in 13 bits, the state in 3.
    next2, next1 = np.zeros(lanes * SLOTS, np.uint16), np.zeros(lanes * SLOTS, np.uint16)
    prev, before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    live = lanes - np.searchsorted(sizes[::-1], np.arange(steps), side="right")
    lane = np.arange(lanes)
    shelf, nook = lane * BLOCK, lane * SLOTS
    shift, place = np.uint16(13), np.uint16(BLOCK - 1)

    def shifted(n: int) -> None:
        k = np.flatnonzero(span[:n] <= _LOW32)
        if len(k):
            code[k] = (code[k] << np.uint64(16)) | words[base[k] + np.minimum(pos[k], width - 1)]
            span[k] <<= np.uint64(16)
            pos[k] += 1

    for t in range(steps):
        n = int(live[t])
        at2 = nook[:n] + _slot2(prev[:n], before[:n])
        at1 = nook[:n] + (prev[:n] & np.uint32(SLOTS - 1))
        told2, told1 = next2[at2], next1[at1]
        row = mixer.mixed((told2 >> shift).astype(np.int64), (told1 >> shift).astype(np.int64), n)
        unit = span[:n] >> np.uint64(15)
        s = _trues(row <= np.minimum(code[:n] // unit, _ONE - 1).astype(np.int32)[:, None]) - 1
        flat = row.ravel()
        at = mixer.flat[:n] + s
        lo = flat[at]
        hi = np.where(s == _SYMBOLS - 1, _ONE, flat[np.minimum(at + 1, _SYMBOLS * n - 1)])
        code[:n] -= unit * lo.astype(np.uint64)
        span[:n] = unit * (hi - lo).astype(np.uint64)
        shifted(n)
        old, new = np.flatnonzero(s == 2), np.flatnonzero(s == 3)
        r = (np.where(s == 0, told2, told1) & place).astype(np.int64)
        if len(old):
            unit = span[old] // np.uint64(t)
            r[old], below, many = seen.find(old, np.minimum(code[old] // unit, np.uint64(t - 1)).astype(np.int64))
            code[old] -= unit * below.astype(np.uint64)
            span[old] = unit * many.astype(np.uint64)
        got = known.take(shelf[:n] + r).astype(np.uint32)
        if len(new):
            unit = span[new] // total[new]
            high, below, many = fresh.find(new, np.minimum(code[new] // unit, total[new] - np.uint64(1)).astype(np.int64))
            code[new] -= unit * below.astype(np.uint64)
            span[new] = unit * many.astype(np.uint64) >> np.uint64(8)
            plain = np.minimum(code[new] // span[new], np.uint64(255))
            code[new] -= plain * span[new]
            fresh.add(new, high, _MORE)
            total[new] += np.uint64(_MORE)
            r[new] = n_known[new]
            got[new] = (high << 8) + plain.astype(np.int64)
            known[new * BLOCK + np.minimum(r[new], BLOCK - 1)] = got[new]
            n_known[new] += 1
        shifted(n)
        mixer.learn(s, n)
        r = np.minimum(r, BLOCK - 1)
        seen.add(n, r)
        r = r.astype(np.uint16)
        for slots, where, told in ((next2, at2, told2), (next1, at1, told1)):
            state = told >> shift
            state = np.where((state > 0) & (told & place == r), np.minimum(state + 1, 4), 1).astype(np.uint16)
            slots[where] = r | (state << shift)
        ids[t, :n] = got
        before[:n], prev[:n] = prev[:n], got
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * lanes
    for j, k in enumerate(order):
        mine = np.ascontiguousarray(ids[: sizes[j], j].astype("<u4"))
        if zlib.crc32(mine.tobytes()) != heads[k][1]:
            raise ValueError("a block's checksum does not hold")
        out[k] = mine
    return out
