"""Assembly statistics and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import codons, gc_percent


def length_stats(df: DataFrame, group: str, length: str = "length") -> DataFrame:
    """Count, total, min, max, auN and N50/N90 per group.

    Nx is the first length, ascending, whose running sum reaches total * (100 - x) / 100.
    Equal lengths are merged first, so the window holds distinct lengths only.
    """
    by_length = df.groupBy(group, F.col(length).cast("long").alias("_l")).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(group).orderBy("_l").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = by_length.withColumn("_cum", F.sum(F.col("_l") * F.col("_c")).over(order)).withColumn("_tot", F.sum(F.col("_l") * F.col("_c")).over(Window.partitionBy(group)))
    nx = lambda x: F.min(F.when(100 * F.col("_cum") >= F.col("_tot") * (100 - x), F.col("_l"))).alias(f"n{x}")
    squares = F.sum(F.col("_l").cast("double") * F.col("_l") * F.col("_c"))
    return run.groupBy(group).agg(
        F.sum("_c").alias("n_seqs"), F.sum(F.col("_l") * F.col("_c")).alias("total_len"), F.min("_l").alias("min_len"), F.max("_l").alias("max_len"),
        (squares / F.sum(F.col("_l") * F.col("_c"))).alias("aun"), nx(50), nx(90),
    )


def mean_gc(df: DataFrame, group: str, sequence: str = "sequence") -> DataFrame:
    """Unweighted mean of per-record GC percent."""
    return df.groupBy(group).agg(F.avg(gc_percent(F.col(sequence))).alias("gc_percent"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def codon_bias(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Count of each codon in frame 1 and its count over 64."""
    rows = df.select(F.explode(codons(F.col(sequence))).alias("codon"))
    return rows.groupBy("codon").agg(F.count("*").alias("n")).withColumn("bias", F.col("n") / F.lit(64.0))


def column_widths(df: DataFrame) -> DataFrame:
    """One row: each column's longest value in letters, 0 without values."""
    return df.agg(*[F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)).alias(c) for c in df.columns])


def record_lengths(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Total length of the records of each (file, id)."""
    return df.groupBy("file", "id").agg(F.sum(F.length(sequence)).cast("long").alias("length"))


def matching_counts(df: DataFrame, group: str, matches: Column) -> DataFrame:
    """Per group: rows that match, and all rows."""
    return df.groupBy(group).agg(F.count_if(matches).alias("n_matches"), F.count("*").alias("n"))


def longest(df: DataFrame, group: str, length: str, n: int, order: str) -> DataFrame:
    """The ``n`` longest rows of each group, ties by ``order``."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(length), order))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among ``seen``; null keys stay."""
    return df.join(seen.select(key), key, "left_anti")
