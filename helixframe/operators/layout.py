"""Spreading rows before work that costs far more than moving them, and joins of sides that both grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def spread(df: DataFrame) -> DataFrame:
    """The same rows over the session's shuffle partitions (at least one a core), so that a few input files don't make a few long tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def meet(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """A join that shuffles both sides. Rows that a small file is exploded to are taken for as small as the file, and would be broadcast through the driver and to every task."""
    return left.join(right.hint("merge"), on, how)
