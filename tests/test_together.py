"""Short texts of equal lengths are aligned and folded together, as each alone."""

import random

import pytest

from helixframe.operators import alignment, gapped as G

SCHEMES = [G.GLOBAL, G.LOCAL, G.FREE_ENDS, G.COUNTED, G.MERGING, G.FAMILY, G.Scheme(2, -3, -2, floor=-1), G.Scheme(begin_gap=-1, end_gap=-3), G.Scheme(local=True, ties="dul")]


@pytest.mark.parametrize("scheme", SCHEMES)
def test_alignments(scheme, monkeypatch):
    rng = random.Random(5)
    a, b = (["".join(rng.choices("ACGac\U0001f600", k=rng.choice((0, 1, 2, 5, 9, 14)))) for _ in range(1500)] for _ in range(2))
    want = [G.align_one(x, y, scheme) for x, y in zip(a, b, strict=True)]
    assert G.align_all(a, b, scheme) == want
    monkeypatch.setattr(G, "BLOCK_CELLS", 1 << 10)
    monkeypatch.setattr(G, "SHORT_CELLS", 100)
    assert G.align_all(a, b, scheme) == want


def test_folds(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choices("ACGU" if k % 3 else "AUNx中", k=rng.choice((0, 1, 2, 3, 8, 17, 32)))) for k in range(1500)]
    want = [alignment.fold_rna(t) for t in texts]
    assert alignment.fold_all(texts) == want
    monkeypatch.setattr(alignment, "BLOCK_CELLS", 1 << 12)
    monkeypatch.setattr(alignment, "SHORT_LETTERS", 20)
    assert alignment.fold_all(texts) == want


def test_many_short_texts_take_few_steps(monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choices("ACGU", k=32)) for _ in range(200)]
    alone = lambda *_: pytest.fail("one at a time")
    monkeypatch.setattr(G, "align_one", alone)
    monkeypatch.setattr(alignment, "fold_rna", alone)
    assert len(G.align_all(texts, texts[::-1], G.COUNTED)) == len(G.merge_all(texts, texts)) == len(alignment.fold_all(texts)) == 200
