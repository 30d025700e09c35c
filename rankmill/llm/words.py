"""Words, their hashes and runs of consecutive words, in Arrow batches.

Words are maximal runs of letters, digits and underscores of any script,
lower-cased.  Hashes are 64 bits and the same in every process.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd

WORD = re.compile(r"\w+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_EMPTY = np.zeros(0, np.uint64)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def hash_words(tokens: list[str]) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not tokens:
        return _EMPTY
    a = np.empty(len(tokens), object)
    a[:] = tokens
    return pd.util.hash_array(a, categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` consecutive words, from the words' hashes."""
    if len(h) < n:
        return _EMPTY
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out + _MIX[0] + h[i : len(h) - n + 1 + i])
    return out


def runs_of_texts(texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word runs of many texts in one array, and each text's number of them.

    One call hashes all words; runs across a border between texts are left out.
    """
    tokens = [words(t) for t in texts]
    counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
    h = hash_words([w for t in tokens for w in t])
    have = np.maximum(counts - n + 1, 0)
    r = run_hashes(h, n)
    starts = np.cumsum(counts) - counts
    keep = np.repeat(starts - (np.cumsum(have) - have), have) + np.arange(have.sum())
    return r[keep] if len(keep) else _EMPTY, have


def sets_of_runs(runs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs per text, ascending, and their numbers."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((runs, owner))
    r, o = runs[order], owner[order]
    first = np.ones(len(r), bool)
    first[1:] = (r[1:] != r[:-1]) | (o[1:] != o[:-1])
    return r[first], np.bincount(o[first], minlength=len(counts)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all distinct members of two ascending arrays without repeats."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / max(1, len(both) - shared)
