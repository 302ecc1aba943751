"""Crawls: rounds of a frontier over written tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.sources.scratch import new_folder


def crawl(start: DataFrame, follow: Callable[[DataFrame], DataFrame], wanted: int | None = None, rounds: int | None = None) -> DataFrame:
    """(id, round) of all that is reached from ``start`` (id), each in the first round that found it; round 0 is the start.

    ``follow`` takes the last round's ids and returns the ids that they lead to, in a column
    ``id``, however it gets them (a join with pages held, or requests). Ids seen before are
    left out, so every id is followed once. The crawl ends when a round finds nothing new,
    once ``wanted`` ids are known, or after ``rounds`` rounds. Each round is a written
    table, so a lost executor repeats a part of one round only. Null ids are no places.
    """
    spark = start.sparkSession
    folder = new_folder(spark, "crawl")
    schema = f"id {start.schema['id'].dataType.simpleString()}, round int"
    seen = spark.createDataFrame([], schema)
    found, number, total = start.select("id"), 0, 0
    while True:
        path = f"{folder}/round={number}"
        found.where("id IS NOT NULL").distinct().join(seen, "id", "left_anti").write.parquet(path)
        new = spark.read.parquet(path)
        count = new.count()
        total += count
        if not count:
            return seen
        seen = seen.union(new.select("id", F.lit(number)))
        if (wanted is not None and total >= wanted) or number == rounds:
            return seen
        found, number = follow(new).select("id"), number + 1
