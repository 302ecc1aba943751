"""Count tables: merging, appending, related ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_counts(df: DataFrame, samples: list[str], key: str = "key", sample: str = "sample", n: str = "n", *, order: str) -> DataFrame:
    """One row a key, one column a sample; 0 where absent, the last (by ``order``) of keys that a sample repeats."""
    wide = df.groupBy(key).pivot(sample, samples).agg(F.max_by(n, order))
    return wide.select(key, *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(s) for s in samples])


def append_column(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    """Full outer join; numbers missing on either side are 0."""
    return left.join(right, key, "full").na.fill(0)


def merge_related(df: DataFrame, count: str = "n", id_col: str = "id") -> DataFrame:
    """Counts of ids added to the longest id that contains them (ties: least); candidates as in ``dedup.containers``. Null and empty ids stay."""
    from helixframe.operators.dedup import containers

    ids = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("s")).distinct()
    best = containers(ids, ids.withColumnRenamed("s", "l")).groupBy(F.col("s").alias("a")).agg(F.min(F.struct((-F.length("l")).alias("n"), F.col("l").alias("l"))).alias("m"))
    joined = df.join(best, F.col(id_col) == F.col("a"), "left")
    return joined.groupBy(F.coalesce("m.l", F.col(id_col)).alias(id_col)).agg(F.sum(count).alias(count))
