"""Long texts as pieces of bounded length, so that no row or array grows with a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.layout import spread

#: Letters of a piece: a letter is found by counting from its piece's start.
PIECE = 256


def record_key(*columns: str) -> Column:
    """128 bits that tell records by all of ``columns`` (nulls too); copies of a record have one key."""
    told = [c for name in columns for c in (F.col(name).isNull(), F.col(name))]
    return F.struct(F.xxhash64(*told).alias("a"), F.xxhash64(F.lit(7), *reversed(told)).alias("b"))


def pieces(df: DataFrame, overlap: int = 0, size: int = PIECE, sequence: str = "sequence") -> DataFrame:
    """Rows of ``df`` without the text, one for each piece of it: n (the text's length), number (from 0), piece.

    A piece goes on for ``overlap`` letters (no more than ``size``) into the next
    one. Null and empty texts have none. The text is cut in one pass.
    """
    if overlap > size:
        raise ValueError("an overlap is no longer than a piece")
    others = [c for c in df.columns if c != sequence]
    cut = df.select(*others, F.length(sequence).alias("n"), F.regexp_extract_all(sequence, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("_p"))
    if overlap:
        cut = cut.withColumn("_p", F.when(F.size("_p") < 2, F.col("_p")).otherwise(F.zip_with("_p", F.slice("_p", F.lit(2), F.size("_p")), lambda x, y: F.concat(x, F.coalesce(F.left(y, F.lit(overlap)), F.lit(""))))))
    return cut.select(*others, "n", F.posexplode("_p").alias("number", "piece"))


def windows(df: DataFrame, k: int, sequence: str = "sequence") -> DataFrame:
    """Rows of ``df`` without the text, one for each stretch of ``k`` letters: n, number, piece, at (in the piece, from 1), window."""
    size = max(PIECE, 2 * k)
    held = pieces(spread(df), k - 1, size, sequence)
    # a piece's last k - 1 letters begin no window of their own if the next piece has them
    last = F.least(F.length("piece") - k + 1, F.lit(size))
    rows = held.where(last >= 1).withColumn("at", F.explode(F.sequence(F.lit(1), last)))
    return rows.withColumn("window", F.substring("piece", F.col("at"), F.lit(k)))
