"""Windows with one word replaced, put in or left out: measured recall of the candidates, and exact verification."""

import random

import numpy as np
import pytest

from rankmill.llm import leaks


def _edited(w: list, kind: str, rng: random.Random) -> list:
    p = rng.randrange(1, len(w) - 1)
    return w[:p] + {"replaced": ["zz"], "put in": ["zz", w[p]], "left out": []}[kind] + w[p + 1 :]


@pytest.mark.parametrize("kind", ["replaced", "put in", "left out"])
def test_one_word(spark, kind):
    """Documents hold a whole item of twelve words but for one: at least 0.95 of them are found, each with one edit."""
    rng = random.Random(kind)
    items = [(i, " ".join(f"i{i}x{k}" for k in range(12))) for i in range(300)]
    docs = [(i, " ".join([f"d{rng.randrange(99)}" for _ in range(9)] + _edited(t.split(), kind, rng) + [f"d{rng.randrange(99)}" for _ in range(9)])) for i, t in items]
    frame = lambda x: spark.createDataFrame(x, "id long, text string")
    found = leaks.find_leaks(frame(docs), frame(items), leaks.NEAR).collect()
    assert all(r["doc_id"] == r["item_id"] and r["edits"] == 1 and r["longest"] == 0 for r in found)
    assert len(found) >= 0.95 * len(items)
    assert leaks.find_leaks(frame(docs), frame(items), leaks.EXACT).count() == 0


def test_stretches():
    a = np.arange(1, 13, dtype=np.uint64)[None]
    inserted = np.r_[a[0, :5], np.uint64(99), a[0, 5:]][None]
    missing = np.r_[a[0, :5], a[0, 6:], np.array([77, 78], np.uint64)][None]
    assert leaks.edit_distance(a, inserted, 1).tolist() == leaks.edit_distance(a, missing, 1).tolist() == [1]
    assert leaks.edit_distance(a, np.r_[a[0], np.uint64(5)][None], 1).tolist() == [0]
    assert leaks.edit_distance(a, inserted[:, :12]).tolist() == [2]
