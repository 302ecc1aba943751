"""Crawls, covers and table functions against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import tables
from helixframe.operators import crawl, search


def test_crawl(spark):
    rng = random.Random(1)
    edges = [(a, rng.randrange(300)) for a in range(300) for _ in range(rng.choice([0, 1, 1, 2]))] + [(5, None)]
    links = spark.createDataFrame(edges, "source long, target long")
    follow = lambda ids: links.join(ids, links.source == ids.id).select(F.col("target").alias("id"))
    start = spark.createDataFrame([(7,), (7,), (9,), (None,)], "id long")
    want, frontier, n = {7: 0, 9: 0}, {7, 9}, 0
    while frontier:
        n += 1
        frontier = {b for a, b in edges if a in frontier and b is not None and b not in want}
        want |= dict.fromkeys(frontier, n)
    assert {r.id: r["round"] for r in crawl.crawl(start, follow).collect()} == want
    assert {r.id for r in crawl.crawl(start, follow, rounds=1).collect()} == {k for k, v in want.items() if v <= 1}
    some = crawl.crawl(start, follow, wanted=6).collect()
    assert 6 <= len(some) < len(want) and all(want[r.id] == r["round"] for r in some)
    assert crawl.crawl(start.where("id = 0"), follow).count() == 0


def covered(rows):
    out = []
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-len(r[2] or ""), r[1] is None, r[1] or 0))
        k, seen = len(mine[-1][2] or ""), set()
        for r in mine:
            s = r[2] or ""
            grams = {s[i : i + k] for i in range(len(s) - k + 1)}
            if not grams <= seen:
                out.append(r)
                seen |= grams
    return out


def test_cover(spark):
    rng = random.Random(4)
    rows = [(g, k, "".join(rng.choices("AC" if g == "b" else "ACGT", k=rng.randint(4, 12) if k else 700))) for g in ("a", "b", None) for k in range(60)]
    rows += [("a", None, rows[3][2]), ("z", 1, ""), ("z", 2, "AC"), ("z", 3, None), ("y", 1, "ACGT"), ("y", 1, "ACGT")]
    df = spark.createDataFrame(rows, "g string, id int, sequence string")
    key = lambda r: tuple((x is not None, x or 0 if isinstance(x, int) or x is None else x) for x in r)
    got = sorted(map(str, (tuple(r) for r in search.cover_dedup(df, "g").collect())))
    assert got == sorted(map(str, covered(rows))) and len(got) < len(rows) and key
    assert search.cover_dedup(df.limit(0), "g").count() == 0


def test_cover_of_one_large_group(spark):
    digest = F.md5(F.col("id").cast("string"))
    df = spark.range(100_000).select(F.lit(1).alias("g"), "id", F.translate(F.substring(digest, 1, 8), "0123456789abcdef", "ACGTACGTACGTACGT").alias("sequence"))
    distinct = df.select("sequence").distinct().count()
    assert search.cover_dedup(df, "g").count() == distinct  # all of one length: the first of each text


def test_merged_spans(spark):
    tables.register(spark)
    rng = random.Random(8)
    rows = [(k, a := rng.randrange(400), a + rng.randrange(9), f"n{a}") for k in "ab" for _ in range(60)] + [("c", 1, 1, "x")]
    spark.createDataFrame(rows, "k string, start int, `end` int, name string").createOrReplaceTempView("spans")
    got = spark.sql("SELECT k, start, `end`, n, name FROM merged_spans(TABLE(SELECT * FROM spans) PARTITION BY k ORDER BY (start, `end`), 2)").collect()
    want = []
    for k in "abc":
        for _, a, b, _ in sorted(r for r in rows if r[0] == k):
            if want and want[-1][0] == k and a <= want[-1][2] + 3:
                want[-1][2], want[-1][3] = max(want[-1][2], b), want[-1][3] + 1
            else:
                want.append([k, a, b, 1, f"n{a}" if k != "c" else "x"])
    assert sorted(map(list, got)) == sorted(want)
    with pytest.raises(Exception, match="start and end"):
        spark.sql("SELECT * FROM merged_spans(TABLE(SELECT 1 AS a))").collect()
    with pytest.raises(Exception, match="order"):
        spark.sql("SELECT * FROM merged_spans(TABLE(SELECT * FROM spans) WITH SINGLE PARTITION ORDER BY start DESC)").collect()
