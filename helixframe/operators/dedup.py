"""Exact and containment dedup of sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import kmers


def first_per_sequence(df: DataFrame, order: str, sequence: str = "sequence") -> DataFrame:
    """The first row (by ``order``; of ties any one) of each distinct sequence, null being one; all but a task's first are dropped before the shuffle."""
    turn = F.row_number().over(Window.partitionBy(sequence).orderBy(order))
    return df.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def key_size(length: Column) -> Column:
    """Letters of the blocking key of a text: its length up to 4, then 4, 8, 16 or 32, whatever it holds."""
    return F.when(length < 4, length).when(length < 8, 4).when(length < 16, 8).when(length < 32, 16).otherwise(32)


def containers(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs (s, l) of the texts of ``short`` (s) and ``long`` (l) where l is longer and contains s; both distinct.

    A container holds every substring of what it contains, so candidates come from an equi-join on one of
    them: of up to four windows spread over s, the one that the fewest texts of ``long`` hold. The window's size
    follows from the length of s, so long texts never meet on short keys. Windows carry a hash of their
    text; the texts join the candidates.
    """
    n, m = F.length("s"), F.length("l")
    size = key_size(n)
    short, long = short.where("length(s) > 0"), long.withColumn("h", F.xxhash64("l"))
    starts = F.transform(F.array(*[F.lit(k) for k in range(4)]), lambda k: (F.floor(k * (n - size) / 3) + 1).cast("int"))
    keys = F.array_distinct(F.transform(starts, lambda i: F.substring("s", i, size)))
    sizes = sorted(r[0] for r in short.select(size.alias("k")).distinct().collect())  # seven at most
    windows = F.flatten(F.array(*[F.when(m > k, kmers(F.col("l"), k)).otherwise(F.array().cast("array<string>")) for k in sizes or [1]]))
    held = long.select("h", F.explode(F.array_distinct(windows)).alias("key"))
    often = held.groupBy("key").agg(F.count("*").alias("n"))
    given = short.select("s", F.size(keys).alias("of"), F.explode(keys).alias("key"))
    rarest = given.join(often, "key").groupBy("s").agg(F.min(F.struct("n", "key")).alias("r"), F.count("*").alias("found"), F.max("of").alias("of"))
    chosen = rarest.where("found = of").select("s", F.col("r.key").alias("key"))  # a window that no text holds: no container
    pairs = chosen.join(held, "key").select("s", "h").join(long, "h")
    return pairs.where("length(l) > length(s) AND contains(l, s)").select("s", "l")


def drop_contained(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Drop sequences that a strictly longer one contains; see ``containers``. Nulls stay; the empty text is in any other."""
    texts = df.where(F.col(sequence).isNotNull()).select(F.col(sequence).alias("s")).distinct()
    hits = containers(texts, texts.withColumnRenamed("s", "l")).select("s").distinct()
    empty = texts.where("s <> ''").limit(1).select(F.lit("").alias("s"))
    return df.join(hits.union(empty), F.col(sequence) == F.col("s"), "left_anti")
