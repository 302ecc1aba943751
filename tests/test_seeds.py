"""Seeded places against the comparison of every pair at every place, with runs of codes on both sides."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import mapping, search, seeds

MASK = S.MASK


def differ(a, b):
    return sum(not MASK.get(x, 0) & MASK.get(y, 0) for x, y in zip(a, b, strict=True))


def texts(rng, n, low, high, codes):
    out = []
    for _ in range(n):
        t = "".join(rng.choices("ACGT" + codes, [9, 9, 9, 9] + [1] * len(codes), k=rng.randint(low, high)))
        if codes and rng.random() < 0.4 and len(t) > 6:  # a run of codes
            k, m = rng.randrange(len(t) - 5), rng.choice([3, 5, 9, 20])
            t = (t[:k] + rng.choice("NNRB") * m + t[k + m :])[: len(t)]
        out.append(t)
    return out


@pytest.mark.parametrize(("low", "high", "most"), [(1, 6, 2), (7, 20, 1), (30, 50, 2), (34, 40, 0), (60, 90, 3)])
@pytest.mark.parametrize("codes", ["", "RYNB"])
def test_places(spark, low, high, most, codes, monkeypatch):
    monkeypatch.setattr(seeds, "PIECE", 64)
    rng = random.Random(low * 100 + most)
    refs = texts(rng, 6, 80, 300, codes)
    queries = texts(rng, 8, low, high, codes)
    for k, q in enumerate(queries[:5]):  # some that fit
        at = rng.randrange(len(refs[k]) - len(q) + 1) if len(refs[k]) > len(q) else 0
        queries[k] = refs[k][at : at + len(q)] or q
    short = spark.createDataFrame([(k, q, "+", most) for k, q in enumerate(queries)], "s_key int, s string, form string, most int")
    long = spark.createDataFrame(list(enumerate(refs)), "l_key int, l string")
    got = sorted((r.s_key, r.l_key, r.start, r.mismatch) for r in seeds.fitting(short, long, F.col("n") <= F.col("m")).collect())
    want = sorted((a, b, i + 1, d) for a, q in enumerate(queries) for b, r in enumerate(refs) for i in range(len(r) - len(q) + 1) if (d := differ(q, r[i : i + len(q)])) <= most)
    assert got == want and want


def test_no_pair_meets_without_a_seed(spark):
    q = spark.createDataFrame([(1, "ACGTNNRYACGTACGT"), (2, "NNNNNNNNNNNN")], "id int, sequence string")
    r = spark.createDataFrame([(1, "ACGTACGTRYACGTACGTNNNNACGT" * 3)], "id int, sequence string")
    for df in (search.map_pairs(q, r), search.mutual_windows(q, r), mapping.map_queries(q, r, 2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert df.count()


def test_queries_with_codes_and_copies(spark):
    q = [(1, "ACGTNACGTTAG"), (1, "ACGTNACGTTAG"), (None, "ACGTRACGTTAG"), (3, None), (4, "")]
    r = [(7, "TTACGTGACGTTAGTT"), (7, "TTACGTGACGTTAGTT"), (None, "CTAACGTCACGT"), (8, "")]
    frames = [spark.createDataFrame(x, "id int, sequence string") for x in (q, r)]
    got = sorted(((x.query_id, x.ref_id, x.strand, x.start, x.mismatch) for x in mapping.map_queries(*frames, 1).collect()), key=repr)
    want = []
    for i, s in q:
        for d, t in (("+", s), ("-", S.reverse_complement_text(s or ""))):
            for j, ref in r:
                want += [(i, j, d, k + 1, m) for k in range(len(ref) - len(t or "") + 1) if t and (m := differ(t, ref[k : k + len(t)])) <= 1]
    assert got == sorted(want, key=repr) and len(want) > 6
