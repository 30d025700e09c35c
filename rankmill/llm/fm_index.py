"""A compressed full-text index of one shard of texts, over words.

The shard's texts are written one after another, each closed by its own
separator.  Kept are: the sorted vocabulary (64-bit word hashes), the
Burrows-Wheeler transform as one ascending list of positions per symbol (which
makes a rank a binary search), every ``STEP``-th suffix position, and the
texts' starts and lengths.  That is 4.6 bytes a word, 16 per distinct word and
40 per text on disk; the texts themselves are not kept, ``extract`` walks them
out of the transform.  Loaded, the positions are held as 64-bit keys and the
transform as 32-bit symbols besides, 17 bytes a word in all.

Backward search runs for all patterns of a batch at once: a step is two binary
searches per pattern still alive.
"""

from __future__ import annotations

import io

import numpy as np

STEP = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers by prefix doubling."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    rank = rank.astype(np.int64)
    k = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:] if k < n else second[:0]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        sk = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, sk[1:] != sk[:-1]])
        rank = new
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        k *= 2


class FMIndex:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)
        self.n = int(self.size[0])
        # (symbol, position) as one ascending number, so that ranks of all symbols are one search
        sym = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self._keys = sym * (self.n + 1) + self.places.astype(np.int64)

    @classmethod
    def build(cls, words: np.ndarray, lengths: np.ndarray, ids: np.ndarray, sizes: np.ndarray | None = None) -> FMIndex:
        """``words``: hashes of all texts' words in a row; ``lengths``: words per text; ``ids``: the texts' names; ``sizes``: a number to keep per text."""
        n_texts = len(lengths)
        vocab, code = np.unique(words, return_inverse=True)
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        s = np.empty(len(words) + n_texts, np.int64)
        ends = starts + lengths
        s[ends] = np.arange(n_texts)  # separators sort first and are distinct
        inner = np.ones(len(s), bool)
        inner[ends] = False
        s[inner] = code.reshape(-1) + n_texts
        sa = suffix_array(s)
        bwt = s[sa - 1]
        places = np.argsort(bwt, kind="stable").astype(np.uint32)
        first = np.r_[0, np.cumsum(np.bincount(s, minlength=n_texts + len(vocab)))].astype(np.int64)
        marked = (sa % STEP == 0)
        return cls({
            "size": np.array([len(s)], np.int64), "vocab": vocab, "first": first, "places": places, "starts": starts.astype(np.int64), "lengths": lengths.astype(np.int64),
            "ids": ids.astype(np.int64), "sizes": (lengths if sizes is None else sizes).astype(np.int64), "marked": np.packbits(marked), "samples": sa[marked].astype(np.uint32),
        })

    def dump(self) -> bytes:
        to = io.BytesIO()
        np.savez(to, **{k: v for k, v in self.__dict__.items() if isinstance(v, np.ndarray) and not k.startswith("_")})
        return to.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> FMIndex:
        with np.load(io.BytesIO(blob)) as z:
            return cls({k: z[k] for k in z.files})

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Symbols of word hashes; -1 for a word that the shard doesn't have."""
        if not len(self.vocab):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        return np.where(self.vocab[at] == words, at + len(self.starts), -1)

    def step(self, sym: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the rows whose suffix begins with ``sym`` and goes on with a row in [lo, hi)."""
        base = sym * (self.n + 1)
        return np.searchsorted(self._keys, base + lo), np.searchsorted(self._keys, base + hi)

    def windows(self, sym: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all windows of ``n`` symbols of ``sym``; window i ends before i + n. Empty ranges where there is no match."""
        m = len(sym) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        alive = np.arange(m)
        for k in range(n - 1, -1, -1):
            c = sym[alive + k]
            known = c >= 0
            lo[alive[~known]] = hi[alive[~known]] = 0
            alive = alive[known]
            lo[alive], hi[alive] = self.step(c[known], lo[alive], hi[alive])
            alive = alive[hi[alive] > lo[alive]]
        none = np.ones(m, bool)
        none[alive] = False
        lo[none] = hi[none] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the shard's text of suffix rows, walking back to a sampled one."""
        self._transform()
        if not hasattr(self, "_mark"):
            self._mark = np.unpackbits(self.marked)[: self.n].astype(bool)
            self._upto = np.cumsum(self._mark, dtype=np.uint32) - 1
        rows = rows.astype(np.int64).copy()
        out, todo, walked = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            hit = self._mark[rows[todo]]
            done = todo[hit]
            out[done] = self.samples[self._upto[rows[done]]] + walked
            todo = todo[~hit]
            r = rows[todo]
            rows[todo] = np.searchsorted(self._keys, self._bwt[r].astype(np.int64) * (self.n + 1) + r)
            walked += 1
        return out

    def _transform(self) -> None:
        if not hasattr(self, "_bwt"):
            self._bwt = np.empty(self.n, np.uint32)
            self._bwt[self.places] = np.repeat(np.arange(len(self.first) - 1, dtype=np.uint32), np.diff(self.first))

    def extract(self, texts: np.ndarray) -> list[np.ndarray]:
        """The word hashes of whole texts, walked backward from their separators, all at once."""
        self._transform()
        lengths = self.lengths[texts]
        cut = np.r_[0, np.cumsum(lengths)]
        out = np.empty(cut[-1], np.uint64)
        rows, at, left = texts.astype(np.int64), cut[1:].copy(), np.flatnonzero(lengths > 0)  # a separator's suffix sorts at the text's own number
        gone = np.zeros(len(texts), np.int64)
        while len(left):
            r = rows[left]
            sym = self._bwt[r].astype(np.int64)
            at[left] -= 1
            out[at[left]] = self.vocab[sym - len(self.starts)]
            rows[left] = np.searchsorted(self._keys, sym * (self.n + 1) + r)
            gone[left] += 1
            left = left[gone[left] < lengths[left]]
        return [out[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def text_at(self, position: np.ndarray) -> np.ndarray:
        """Which text a position belongs to."""
        return np.searchsorted(self.starts, position, side="right") - 1
