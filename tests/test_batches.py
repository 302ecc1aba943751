"""Spans merged by Arrow batches and by rows give the same; k-mers of windows are those of each window alone."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import coding, tables
from helixframe.operators import search

SQL = "SELECT k, name, start, `end`, n FROM merged_spans(TABLE(SELECT k, name, start, `end` FROM some_spans) PARTITION BY k ORDER BY (start, `end`, name), {})"


@pytest.mark.parametrize("gap", [2, 0, -1, -3])
def test_spans_by_batches(spark, gap):
    rng = random.Random(9)
    rows = [(k, f"n{i}", a := rng.randrange(900), a + rng.randrange(-3 if k == "c" else 0, 9)) for k in "abc" for i in range(150)] + [("d", None, 1, 1), (None, "x", 1 << 61, (1 << 63) - 2)]
    spark.createDataFrame(rows, "k string, name string, start long, `end` long").createOrReplaceTempView("some_spans")
    tables.register(spark)
    want = sorted(map(str, spark.sql(SQL.format(gap)).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("10000", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            tables.register(spark, "k string, name string")
            assert sorted(map(str, spark.sql(SQL.format(gap)).collect())) == want
        with pytest.raises(Exception, match="order"):
            spark.sql("SELECT * FROM merged_spans(TABLE(SELECT k, name, start, `end` FROM some_spans) WITH SINGLE PARTITION ORDER BY start DESC)").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        tables.register(spark)


def test_windows_by_places(spark):
    rng = random.Random(10)
    rows = [tuple("".join(rng.choices("ACGTNRx", k=rng.randrange(0, 26))) for _ in range(2)) for _ in range(60)] + [("A" * 40, "A" * 9), (None, "A"), ("NNNNNNNN", "ACGTAC")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a string, b string")
    got = {(r.id, r.start, r.end): r.similarity for r in search.map_windows(df, "a", "b", -1.0).collect()}
    each = [(i, s, max(a, b, key=len) if len(a) != len(b) else a, min(a, b, key=len) if len(a) != len(b) else b) for i, (a, b) in enumerate(rows) if a and b for s in range(1, abs(len(a) - len(b)) + 2)]
    each = spark.createDataFrame([(i, s, s + len(y) - 1, x[s - 1 : s - 1 + len(y)], y, max(3, len(y) // 5)) for i, s, x, y in each], "id int, start int, end int, w string, s string, k int")
    want = {(r.id, r.start, r.end): r.v for r in each.withColumn("v", coding.kmer_similarity(F.col("s"), F.col("w"), F.col("k"))).collect()}
    assert got == want
