"""Delimited inputs: count tables and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def count_value(v: Column) -> Column:
    """Digits as a number; anything else is 0."""
    return F.when(v.rlike("^[0-9]+$"), F.try_cast(v, "bigint") if hasattr(F, "try_cast") else v.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """key, n, sample (file stem); rows of one column are left out."""
    rows = spark.read.schema("key string, v string").option("sep", "\t").csv(path).select("key", "v", F.col("_metadata.file_name").alias("file"))
    return rows.where("v IS NOT NULL").select("key", count_value(F.col("v")).alias("n"), F.regexp_replace("file", r"\.[^.]*$", "").alias("sample"))


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, start int, end int, annotation string").option("sep", "\t").csv(path)
