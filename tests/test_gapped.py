"""Alignment schemes against plain dynamic programs, merging, families, strands."""

import itertools
import random

import pytest

from helixframe.operators import gapped as G


def plain_score(a, b, s):
    """The defining recurrence, cell by cell."""
    begin = 0 if s.local else s.gap if s.begin_gap is None else s.begin_gap
    end = s.gap if s.end_gap is None or s.local else s.end_gap
    h = {(0, 0): 0}
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        if not i or not j:
            h[i, j] = begin * (i + j)
            continue
        step = s.match if a[i - 1] == b[j - 1] else s.mismatch
        step = step if s.floor is None else max(step, s.floor)
        v = max(h[i - 1, j - 1] + step, h[i - 1, j] + (end if j == len(b) else s.gap), h[i, j - 1] + (end if i == len(a) else s.gap))
        h[i, j] = max(v, 0) if s.local else v
    return max(h.values()) if s.local else h[len(a), len(b)]


@pytest.mark.parametrize("scheme", [G.GLOBAL, G.LOCAL, G.FREE_ENDS, G.COUNTED, G.MERGING, G.FAMILY, G.Scheme(2, -3, -2, floor=-1), G.Scheme(begin_gap=-1, end_gap=-3)])
def test_schemes(scheme):
    rng = random.Random(3)
    for _ in range(120):
        a, b = ("".join(rng.choices("ACG", k=rng.randint(0, 14))) for _ in range(2))
        r = G.align_one(a, b, scheme)
        assert r.score == plain_score(a, b, scheme)
        assert r.first.replace("-", "") == a[r.start1 - 1 : r.end1] and r.second.replace("-", "") == b[r.start2 - 1 : r.end2]
        assert len(r.first) == len(r.second) == r.n_match + r.n_mismatch + r.n_gap
        if scheme.local:
            assert r.score == scheme.match * r.n_match + scheme.mismatch * r.n_mismatch + scheme.gap * r.n_gap
        else:
            assert (r.start1, r.end1, r.start2, r.end2) == (1, len(a), 1, len(b))


def test_case_and_ties():
    assert G.align_one("acgt", "ACGT", G.FREE_ENDS).n_match == 4
    r = G.align_one("AAGAA", "AA", G.LOCAL)
    assert (r.start1, r.end1) == (1, 2)
    r = G.align_one("AAGAA", "AA", G.COUNTED)
    assert (r.start1, r.end1) == (4, 5)


def test_merging():
    assert G.merge_two("GGTTGAT", "AGGTTG") == "AGGTTGAT"
    assert G.merge_two("AAAA", "CCCC") is None and G.merge_two("", "A") is None


def test_families(spark):
    assert G.align_family_texts([]) == [] and G.align_family_texts(["AC"]) == ["AC"]
    out = G.align_family_texts(["ACGT", "ACG", "CGT"])
    assert len({len(s) for s in out}) == 1 and [s.replace("-", "") for s in out] == ["ACGT", "ACG", "CGT"]
    df = spark.createDataFrame([("f", 1, "ACGT"), ("f", 2, "ACG"), ("g", 3, None)], "fam string, id int, sequence string")
    got = {r.id: r.aligned for r in G.align_families(df, "fam").collect()}
    assert got[3] == "" and len(got[1]) == len(got[2])
    scores = G.pair_scores(df, "fam").collect()
    assert [(r.id1, r.id2, r.distance) for r in scores] == [(1, 2, -6)]


def test_columns(spark):
    df = spark.createDataFrame([(1, "ACGT", "AGT"), (2, None, "A")], "id int, seq1 string, seq2 string")
    got = {r.id: r for r in G.align_with(df).collect()}
    assert (got[1].score, got[1].aligned2, got[2].aligned1) == (4, "A-GT", "-")
    assert {r.id: r.merged for r in G.merge_reads(df).collect()}[2] is None
    rows = G.fold_strands(spark.createDataFrame([("x", "GGAACC"), ("y", None)], "id string, sequence string"))
    assert {(r.id, r.direction): (r.transcript, r.pairs) for r in rows.collect()} == {("x", "FW"): ("GGAACC", 2), ("x", "RV"): ("GGUUCC", 2), ("y", "FW"): ("", 0), ("y", "RV"): ("", 0)}
    assert rows.select(G.structure_text().alias("t")).first().t.startswith(">x|")
