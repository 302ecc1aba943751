"""What keeps a step's cost in proportion: joins that shuffle both sides, rows dealt over tasks, nothing met in vain."""

import random

import pytest

from helixframe.operators import kmers, mapping, search
from helixframe.plans import registry

SCHEMA = "id int, sequence string"


def texts(seed, count, low, high):
    rng = random.Random(seed)
    return [(k, "".join(rng.choice("ACGT") for _ in range(rng.randint(low, high)))) for k in range(count)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "texts")
    spark.createDataFrame(texts(1, 60, 4, 12), SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("of", [lambda df: kmers.sharing_kmer(df, 4), lambda df: kmers.repeated_kmer(df, 4), lambda df: kmers.repeated_kmer(df), search.find_orfs])
def test_sides_that_grow_are_not_broadcast(stored, of):
    """A file's size tells nothing of the rows that are made of it."""
    assert "BroadcastExchange" not in plan(of(stored))


def test_rows_of_one_file_are_dealt_over_tasks(spark, stored):
    assert search.flanking_primers(stored, 4, 6, 3, -1000.0, 1000.0).rdd.getNumPartitions() >= 4
    for name in ("hairpins", "six_frames", "open_frames"):
        assert registry.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_short_queries_meet_nothing_in_vain(spark, most):
    queries, references = texts(2, 12, 1, 9), texts(3, 15, 1, 14)
    queries, references = queries + queries[:2], references + references[:2]
    want = sorted((a, b, i + 1, i + len(q), d) for a, q in queries for b, r in references for i in range(len(r) - len(q) + 1) if (d := sum(x != y for x, y in zip(q, r[i : i + len(q)], strict=True))) <= most)
    got = mapping.map_queries(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(references, SCHEMA), most, strands=False).drop("strand")
    assert sorted(map(tuple, got.collect())) == want
    q = spark.createDataFrame(queries, SCHEMA).selectExpr("id query_id", "sequence q", "'+' strand")
    met = mapping._whole(q, spark.createDataFrame(references, SCHEMA).selectExpr("id ref_id", "sequence r"), most)
    assert met.count() == len(want)
