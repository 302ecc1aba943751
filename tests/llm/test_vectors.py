"""Hard negatives and nearest neighbours against brute force over all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import hard_negatives, posting_lists

SCHEMA = "vec_id long, embedding array<double>, label int, id long, row long, rank string, list int, norm string"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, l, 1, 2, "x", 3, "y") for k, v, l in rows], SCHEMA).repartition(5)


def table(seed, n, width, big=9):
    """Integer vectors of many norms, with copies of one vector, ties and repeated rows."""
    rng = random.Random(seed)
    hot = [float(rng.randint(-big, big)) for _ in range(width)]
    rows = []
    for k in range(n):
        scale = rng.choice([1, 1, 2, 5])
        v = hot if rng.random() < 0.3 else [float(scale * rng.randint(-big, big)) for _ in range(width)]
        rows.append((k, v, rng.randrange(4)))
    rows += rows[:5] + [(n, None, 1), (n + 1, [1.0] * width, None), (None, [1.0] * width, 1), (n + 2, [None] + [1.0] * (width - 1), 1), (n + 3, [0.0] * width, 2), (n + 4, [], 2), (n + 5, hot[: width - 2], 3)]
    return rows


def negatives(rows, every, positives, wanted, low, high):
    rows = [(k, v, label, at) for at, (k, v, label) in enumerate(rows) if k is not None and v is not None and label is not None and None not in v]
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b, strict=False)))
    out = []
    for k, v, label, at in rows:
        if k % every:
            continue
        scored = [(-dot(v, w), j, other) for j, w, other, there in rows if there != at]
        for p, pos, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            found = sorted(x for x in scored if x[2] != label and -p * low <= -x[0] * 100 <= -p * high)[:wanted]
            out += [(k, pos, r, j, -p, -s) for r, (s, j, _) in enumerate(found, 1)]
    return sorted(out)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("bucket,block,slot", [(2048, 128, 16), (64, 2, 1), (64, 4, 2)])
def test_hard_negatives(spark, monkeypatch, bucket, block, slot):
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "SLOT", slot)
    monkeypatch.setattr(hard_negatives, "STRIP", 8)
    rows = table(3, 400, 6)
    spec = hard_negatives.Spec(positives=3, negatives=4)
    found = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 5 == 0, spec)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found.collect()) == negatives(rows, 5, 3, 4, 30, 90)


def test_buckets_out_of_reach_are_left_out(monkeypatch):
    """A bucket whose norms can't reach any window's limit is not multiplied."""
    rng = np.random.default_rng(1)
    one = lambda scale, at: {"ids": np.arange(at, at + 8), "labels": np.zeros(8, np.int64), "rows": np.arange(at, at + 8), "norms": None, "vectors": (scale * rng.integers(1, 9, (8, 4))).astype("<i4")}
    near, far = one(50, 100), one(1, 200)
    for c in (near, far):
        c["norm"] = float(np.sqrt((c["vectors"].astype(float) ** 2).sum(1)).max())
    far["vectors"] = None  # would fail if it were read
    a = {"vectors": np.array([[5, 5, 5, 5]], "<i4"), "norms": np.array([10.0]), "labels": np.array([0]), "rows": np.array([0]), "owner": np.array([0]), "slot": np.array([0]), "low": np.array([-5]), "high": np.array([1 << 40]), "floor": np.array([-(1 << 62)])}
    ((_, _, score, ids, _),) = hard_negatives.searched([a], [near, far], 3, True)
    want = sorted(((int(v.astype(int).sum()) * 5, -int(k)) for v, k in zip(near["vectors"], near["ids"], strict=True)), reverse=True)[:3]
    assert list(zip(score.tolist(), (-ids).tolist(), strict=True)) == want


def test_hard_negatives_without_anchors_or_rows(spark):
    for rows in ([], [(1, [1.0], 1)], [(0, None, 1)]):
        assert hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0).count() == 0


def test_scores_beyond_a_long(spark):
    with pytest.raises(ValueError, match="scores"):
        hard_negatives.mine(frame(spark, [(0, [3.0e9], 1), (1, [1.0], 1)]), F.col("vec_id") == 0)


def nearest(rows, every, k):
    rows = [(i, v, at) for at, (i, v, _) in enumerate(rows) if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    width = max(len(v) for _, v, _ in rows)
    m = np.array([v + [0.0] * (width - len(v)) for _, v, _ in rows])
    out = {}
    for i, _, at in rows:
        if i % every == 0:
            j = next(n for n, r in enumerate(rows) if r[2] == at)
            d = np.sqrt(((m - m[j]) ** 2).sum(1))
            order = sorted((float(d[n]), rows[n][0]) for n in range(len(rows)) if n != j)[:k]
            out.setdefault(i, []).append(order)
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "query_row", "rank").collect():
        out.setdefault(r.query_id, {}).setdefault(r.query_row, []).append((r.score, r.id))
        assert len(out[r.query_id][r.query_row]) == r["rank"]
    return {q: sorted(found.values()) for q, found in out.items()}


@pytest.mark.parametrize("held", [20, 1 << 17])
def test_neighbours_where_all_lists_are_read(spark, monkeypatch, held):
    monkeypatch.setattr(posting_lists, "LIST_ROWS", 20)
    monkeypatch.setattr(posting_lists, "PART_ROWS", 8)
    monkeypatch.setattr(posting_lists, "QUERY_ROWS", 3)
    monkeypatch.setattr(posting_lists, "RATIO", 1e9)
    monkeypatch.setattr(posting_lists, "_HELD", held)
    rows = table(4, 300, 5) + [(1000, [float("nan")] * 5, 1), (1100, [float("inf")] + [1.0] * 4, 1)]
    found = answers(posting_lists.neighbours(frame(spark, rows), F.col("vec_id") % 10 == 0, 7))
    want = nearest(rows, 10, 7)
    assert set(found) == set(want)
    for q, lists in want.items():
        for a, b in zip(found[q], sorted(lists), strict=True):
            assert [i for _, i in a] == [i for _, i in b]
            assert np.allclose([s for s, _ in a], [s for s, _ in b], rtol=1e-14)


@pytest.mark.parametrize("kind", ["uniform", "clusters"])
def test_recall(spark, kind):
    rng = np.random.default_rng(9)
    if kind == "uniform":
        m = rng.normal(size=(6000, 32))
    else:
        m = rng.normal(size=(60, 32))[rng.integers(0, 60, 6000)] + 0.1 * rng.normal(size=(6000, 32))
        m[:2000] = m[0]  # a third of all rows are copies
    m = m / np.linalg.norm(m, axis=1)[:, None]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(m)]
    found = answers(posting_lists.neighbours(frame(spark, rows), F.col("vec_id") % 100 == 0, 10))
    want = nearest(rows, 100, 10)
    hits = sum(len({i for _, i in found[q][0]} & {i for _, i in want[q][0]}) for q in want)
    assert set(found) == set(want) and hits >= 0.95 * sum(len(x[0]) for x in want.values())


@pytest.mark.parametrize("kind", ["few", "tails", "scales", "shell"])
def test_nothing_nearer_is_missed(spark, kind):
    """Rows far from all others are lists of their own, beside which a ratio to the nearest list says nothing."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(4000, 24))
    if kind == "few":
        m = rng.normal(size=(4000, 8))
    elif kind == "tails":
        m *= rng.lognormal(0, 1.5, (4000, 1))
    elif kind == "scales":
        m = (rng.normal(size=(40, 24)) * 3)[rng.integers(0, 40, 4000)] + m * 10.0 ** rng.integers(-3, 2, (4000, 1))
    else:
        m = m / np.linalg.norm(m, axis=1)[:, None] + 1000 * np.ones(24)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(m)]
    found = answers(posting_lists.neighbours(frame(spark, rows), F.col("vec_id") % 100 == 0, 10))
    want = nearest(rows, 100, 10)
    assert set(found) == set(want) and all([i for _, i in found[q][0]] == [i for _, i in want[q][0]] for q in want)


def test_graph_finds_what_a_scan_finds():
    rng = np.random.default_rng(2)
    centroids = rng.normal(size=(700, 16))
    graph = posting_lists.Graph(centroids)
    x = rng.normal(size=(50, 16))
    scan = np.argsort(posting_lists.distances(x, centroids), 1)
    found, _ = graph.nearest(x, 32)
    assert np.mean([len(set(a[:10].tolist()) & set(b[:10].tolist())) / 10 for a, b in zip(found, scan, strict=True)]) > 0.95
    d = np.sqrt(posting_lists.distances(x, centroids))
    got = graph.within(x, 1.2, 4)
    want = [set(np.flatnonzero(d[k] <= 1.2 * d[k].min()).tolist()) | set(scan[k, :4].tolist()) for k in range(len(x))]
    assert min(map(len, got)) >= 4 and sum(len(a & set(b.tolist())) for a, b in zip(want, got, strict=True)) >= 0.95 * sum(map(len, want))


def test_balanced_lists():
    points = np.random.default_rng(3).normal(size=(1000, 8))
    points[:400] = points[0]
    sizes = [len(x) for x in posting_lists.halved(points, 13)]
    assert len(sizes) == 13 and sum(sizes) == 1000 and max(sizes) - min(sizes) <= 4


def test_neighbours_without_queries_or_rows(spark):
    for rows in ([], [(0, [1.0, 2.0], 1)], [(1, [1.0], 1), (2, [2.0], 1)], [(0, None, 1), (100, [0.0], 1)]):
        assert posting_lists.neighbours(frame(spark, rows), F.col("vec_id") % 100 == 0).count() == 0
