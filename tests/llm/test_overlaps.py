"""The index gives its texts back, and candidates are pruned without losing a pair, whatever the bound of lookups."""

import random

import numpy as np
import pytest

from rankmill.llm import overlaps
from rankmill.llm.fm_index import FMIndex
from rankmill.llm.words import hash_words


def test_extract_and_size():
    rng = random.Random(1)
    texts = [[f"w{rng.randrange(300)}" for _ in range(rng.choice([0, 1, 5, 60]))] for _ in range(400)]
    n = np.array([len(t) for t in texts])
    h = hash_words([w for t in texts for w in t])
    ix = FMIndex.load(FMIndex.build(h, n, np.arange(400)).dump())
    cut = np.r_[0, np.cumsum(n)]
    some = np.array(rng.sample(range(400), 90))
    for i, got in zip(some, ix.extract(some), strict=True):
        assert (got == h[cut[i] : cut[i + 1]]).all()
    assert not hasattr(ix, "text")
    assert len(ix.dump()) < 4.7 * (len(h) + 400) + 16 * 300 + 40 * 400 + 5000


@pytest.mark.parametrize("run, located", [(1, 10), (1, 2_000_000), (2, 37)])
def test_frequent_words(run, located):
    """Texts of few different words: every pair at or above the threshold is found, and most others are never compared."""
    rng = random.Random(run)
    texts = [[f"w{rng.randrange(12)}" for _ in range(rng.randint(3, 9))] for _ in range(160)]
    s = overlaps.Settings(threshold=0.7, run=run, located=located)
    held, train = texts[:80], texts[80:]
    n = np.array([len(t) for t in held])
    h = hash_words([w for t in held for w in t])
    ix = FMIndex.build(h, n, np.arange(80), overlaps.sets_of_runs(*overlaps._runs(h, n, run)[:2])[1])
    sets = lambda t: {tuple(t[i : i + run]) for i in range(len(t) - run + 1)}
    want = {(1000 + i, j) for i, a in enumerate(train) for j, b in enumerate(held) if sets(a) and sets(b) and len(sets(a) & sets(b)) >= 0.7 * len(sets(a) | sets(b))}
    got = list(overlaps._Chunk([1000 + i for i in range(80)], train, s).search(ix, s))
    assert {g[:2] for g in got} == want and len(got) == len(want)
