"""Open reading frames of texts of any length, in work linear in the text.

A text's codons are read in pieces; of them only starts and stops become rows.
The next stop of a start is the least one behind it in its frame: found among
the rows of one block of the text by a running minimum, or, for the starts that
a block leaves open, the first stop of a later block. So a chromosome's frames
are shared out over many tasks. Records are told by row, not by id; repeated
rows have their frames each, null ids stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import reverse_complement
from helixframe.operators.layout import meet, spread
from helixframe.operators.pieces import PIECE, pieces, record_key

#: Letters of a block, whose starts and stops one task sorts.
BLOCK = 1 << 20
STARTS, STOPS = ("ATG", "TTG", "CTG", "GTG"), ("TAA", "TAG", "TGA")


def _codons(df: DataFrame, starts: tuple[str, ...]) -> DataFrame:
    """(_key, id, strand, n, at, stop) of every start and stop codon, in coordinates of its strand."""
    s = F.col("sequence")
    both = df.withColumn("strand", F.lit("+")).select("_key", "id", "strand", s).union(df.select("_key", "id", F.lit("-"), reverse_complement(s, "acgt")))
    held = pieces(both, overlap=2).where("length(piece) >= 3")
    rows = held.withColumn("i", F.explode(F.sequence(F.lit(1), F.least(F.length("piece") - 2, F.lit(PIECE)))))
    rows = rows.withColumn("codon", F.substring("piece", F.col("i"), F.lit(3))).where(F.col("codon").isin(*starts, *STOPS))
    return rows.select("_key", "id", "strand", "n", (F.col("number") * PIECE + F.col("i")).alias("at"), F.col("codon").isin(*STOPS).alias("stop"))


def frames(df: DataFrame, starts: tuple[str, ...] = STARTS) -> DataFrame:
    """(_key, id, strand, n, start, end) from each start codon to the first stop in its frame, 1-based on its own strand; ``df``: id, sequence."""
    told = spread(df).select(record_key("id", "sequence").alias("_key"), "id", "sequence")
    rows = _codons(told, starts).withColumn("frame", F.col("at") % 3).withColumn("block", F.floor(F.col("at") / BLOCK).cast("int"))
    by = ["_key", "strand", "frame"]
    behind = Window.partitionBy(*by, "block").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("next", F.min(F.when(F.col("stop"), F.col("at"))).over(behind)).where("NOT stop")
    heads = rows.where("stop").groupBy(*by, "block").agg(F.min("at").alias("head"))
    # a block's open starts go on to the first stop of the nearest later block that has one
    reach = heads.withColumn("from", F.coalesce(F.lag("block").over(Window.partitionBy(*by).orderBy("block")), F.lit(-1)))
    later = reach.where("from < block").select(*by, F.explode(F.sequence(F.col("from"), F.col("block") - 1)).alias("block"), "head").where("block >= 0")
    closed = near.where("next IS NOT NULL")
    opened = meet(near.where("next IS NULL").drop("next"), later, [*by, "block"]).withColumnRenamed("head", "next")
    columns = ["_key", "id", "strand", "n", F.col("at").cast("int").alias("start"), (F.col("next") + 2).cast("int").alias("end")]
    return closed.select(*columns).union(opened.select(*columns))


def cut_out(df: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (_key, strand, start, end, others) with the sequence of each, from the pieces it lies in; ``-`` gives the reverse complement. ``df``: id, sequence."""
    told = df.select(record_key("id", "sequence").alias("_key"), "sequence")
    held = pieces(told, size=PIECE).groupBy("_key", "number").agg(F.first("piece").alias("piece"))  # copies have the same
    at = lambda c: F.floor((F.col(c) - 1) / PIECE).cast("int")
    parts = meet(spans.withColumn("number", F.explode(F.sequence(at("start"), at("end")))), held, ["_key", "number"])
    low = F.greatest(F.col("start") - F.col("number") * PIECE, F.lit(1))
    part = F.substring("piece", low, F.least(F.col("end") - F.col("number") * PIECE, F.lit(PIECE)) - low + 1)
    whole = parts.groupBy(*spans.columns).agg(F.array_sort(F.collect_list(F.struct("number", part.alias("part")))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x.part), "")
    return whole.select(*spans.columns, F.when(F.col("strand") == "-", reverse_complement(text, "acgt")).otherwise(text).alias("sequence"))
