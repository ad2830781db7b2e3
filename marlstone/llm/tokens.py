"""Token ids of whole texts by the tokenizers library, with a cache of the ids of each run of non-space characters."""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import encoded

#: Cached runs after which those seen once since then are forgotten; bounds a worker's memory.
CACHE = 500_000
#: Runs encoded as one text, the end-of-text token between them.
JOINED = 500
#: Lower-cased runs of printable ASCII without apostrophes and Latin-1 letters, which no normalizer changes further, and their pre-tokens.
_PLAIN = re.compile("[!-&(-@[-~ß-öø-ÿ]+")
_PIECES = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Plain pre-tokens, on which the model alone is tried against the whole tokenizer.
_TRIED = "a the word of qzx abcdefghijklmnopqrstuvwxyz internationally straße àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ 0 1 2 3 4 5 6 7 8 9 . ,.!? *** !\"#$%&()*+ -/:;<=>?@ [\\]^_`{|}~"
_SPACE = bytes(32 if c in b"\t\n\r" else c for c in range(256))


class WordTokenizer:
    """Ids of texts by a lower-casing tokenizer whose pre-tokenizer drops white space and keeps letters, digits and the rest apart.

    Texts are cut at spaces, tabs and line ends, where such a tokenizer cuts them too, so equal runs are encoded once. The
    cutting and the search for equal runs are Arrow's. A text that holds a special token's opening is encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        #: The same model without normalizer and search for pre-tokens, for text cut into plain ones.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        if self.bare.encode(_TRIED).ids != self.tokenizer.encode(_TRIED, add_special_tokens=False).ids:
            self.bare = self.tokenizer
        self.end = self.tokenizer.token_to_id("<|endoftext|>")
        #: Which ids end a pre-token.
        self.closes = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}
        self.flat, self.start, self.size, self.seen = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def trim(self) -> None:
        """Keep what was seen more than once, or nothing if that is most of it."""
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > CACHE * 3 // 4:
            self.forget()
            return
        words = list(self.known)
        known = [words[k] for k in keep.tolist() if k]
        keep = keep[keep > 0]
        size = self.size[keep]
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(self.start[keep] - (ends - size), size) + np.arange(int(size.sum()))]
        self.forget()
        self._add(known, flat, size)

    def _add(self, words: list[bytes], flat: np.ndarray, size: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.seen = np.concatenate([self.seen, np.zeros(len(size), np.int64)])
        self.flat = np.concatenate([self.flat, flat])

    def _encoded(self, words: list[bytes], between: bytes, bare: bool = False) -> list[np.ndarray]:
        joined = [between.join(words[k : k + JOINED]).decode() for k in range(0, len(words), JOINED)]
        return [np.array(e.ids, np.uint32) for e in (self.bare if bare else self.tokenizer).encode_batch_fast(joined, add_special_tokens=False)]

    def learn(self, words: list[bytes]) -> None:
        """Encode runs many at a time: those whose pre-tokens are known or that have one at least, with spaces between them, others with an end token.

        Control characters may be white space to the tokenizer, so that a run of them has no pre-token and another two.
        """
        plain: list[bytes] = []
        cut: list[bytes] = []
        parts: list[int] = []
        easy: list[bytes] = []
        hard: list[bytes] = []
        for w in words:
            text = w.decode().lower()
            if _PLAIN.fullmatch(text):
                plain.append(w)
                own = [text] if text.isalpha() else _PIECES.findall(text)
                cut.append(" ".join(own).encode())
                parts.append(len(own))
            elif text.isalpha():
                easy.append(w)
            else:
                hard.append(w)
        if self.end is None:
            got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
            self._add(words, np.concatenate(got), np.array([len(g) for g in got], np.int64))
            return
        for own, as_cut, many, bare in ((plain, cut, parts, True), (easy, easy, [1] * len(easy), False)):
            sure: list[bytes] = []
            flat: list[np.ndarray] = []
            sizes: list[np.ndarray] = []
            for k, ids in enumerate(self._encoded(as_cut, b" ", bare)):
                at = slice(k * JOINED, (k + 1) * JOINED)
                last, want = np.flatnonzero(self.closes[ids]), np.cumsum(many[at])
                if len(last) != want[-1]:
                    hard += own[at]  # not as counted
                    continue
                sure += own[at]
                flat.append(ids)
                sizes.append(np.diff(last[want - 1], prepend=-1))
            if sure:
                self._add(sure, np.concatenate(flat), np.concatenate(sizes))
        if hard:
            every = np.concatenate([np.append(e, np.uint32(self.end)) for e in self._encoded(hard, b"<|endoftext|>")])
            between = every == self.end
            self._add(hard, every[~between], np.diff(np.flatnonzero(between), prepend=-1) - 1)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) one text after the other, and how many each text has; null has none."""
        if any(t and "<|" in t for t in texts):
            parts = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        if len(self.known) > CACHE:
            self.trim()
        cut = pc.split_pattern(pa.array([encoded(t).lower().translate(_SPACE) for t in texts], pa.large_binary()), " ")
        runs = cut.values.dictionary_encode()
        counts = np.diff(cut.offsets.to_numpy())
        words = runs.dictionary.to_pylist()
        own = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(own < 0)
        if len(missing):
            lost = [words[k] for k in missing.tolist()]
            self.learn(lost)
            own[missing] = np.fromiter(map(self.known.__getitem__, lost), np.int64, len(lost))
        at = own[runs.indices.to_numpy()]
        self.seen += np.bincount(at, minlength=len(self.seen))
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[at] - ends[:-1], size) + np.arange(ends[-1])]
        edge = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[edge[1:]] - ends[edge[:-1]]


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def forget_all() -> None:
    """Let go of this worker's tokenizers and their caches."""
    _loaded.clear()


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with `end` after each text's, and the counts with it."""
    return np.insert(ids, np.cumsum(counts), end), counts + 1


def slices_by_size(texts: list[str | None], most: int = 4 << 20) -> list[slice]:
    """Slices of texts of about `most` characters each, one text at least."""
    out, start, size = [], 0, 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if k > start and size + n > most:
            out.append(slice(start, k))
            start, size = k, 0
        size += n
    if start < len(texts):
        out.append(slice(start, len(texts)))
    return out
