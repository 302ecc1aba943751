"""Places of short texts in long ones through seeds, ambiguity codes on either side; letters are compared only where a seed is shared.

A text that fits a place within ``most`` mismatches is cut into ``most`` + 1
pieces, of which one fits without any, or ``most`` + 2, of which two do. So every
place shares the seed of one piece (its first 32 or 16 letters, or a shorter piece
up to 12) or of two pieces with the distance between them.

Seeds with ambiguity codes are told by the plain texts they stand for, as two
seeds fit if they have one in common. A seed that stands for more than ``cells.WAYS``
is told by its longest beginning that does not, and two seeds meet on the shorter of
their beginnings. So runs of N cost that many hashes a letter at most, and plain texts one.

Seeds and candidates are never rows. Short texts are dealt into blocks, pieces of
long ones into slices, and each block meets each slice in a cell: a text is sent
once a slice, a piece once a block, and places leave the cell compared and with the
columns of both texts. A cell holds its block's seeds, reads its slice a batch at a time
and returns places as they are found. What is sent grows with texts times slices,
one for ``SLICE`` letters, and letters times blocks, one for about ``BLOCK`` hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from helixframe.functions.sequence import MASK
from helixframe.operators.cells import PAIRED, Block
from helixframe.operators.pieces import PIECE, pieces, record_key

#: Hashes of a block (as estimated), letters of a slice, and of one that is cut only so that all cores have work.
BLOCK, SLICE, LEAST = 1 << 21, 1 << 22, 1 << 16
_CODES = {n: "".join(c for c, m in MASK.items() if m.bit_count() == n) for n in (2, 3, 4)}


def _ways(text: Column) -> Column:
    """Logarithm (base 2) of the plain texts that a text stands for."""
    count = lambda letters: F.length(text) - F.length(F.translate(text, letters, ""))
    return count(_CODES[2]) + F.lit(1.584963) * count(_CODES[3]) + 2 * count(_CODES[4])


def _weight(nucleotide: bool) -> Column:
    """About the hashes of a short text (s, most), or its letters if these are more."""
    n, most = F.length("s"), F.col("most").cast("long")
    one, two = F.floor(n / (most + 1)), F.floor(n / (most + 2))
    paired = (one < 8) & (two >= 2) & (most <= PAIRED)
    seeds = F.when(paired, (most + 1) * (most + 2) / 2).otherwise(most + 1)
    letters = F.when(paired, 2 * two).otherwise(F.least(one, F.lit(32)))
    return F.greatest(seeds * F.pow(F.lit(2.0), F.least(_ways(F.col("s")) * letters / n, F.lit(8.0)) if nucleotide else F.lit(0.0)), n)


def _dealt(asked: DataFrame, held: DataFrame, size: int, nucleotide: bool, mutual: bool, schema: StructType, parts: int) -> DataFrame:
    """The places of each cell. ``asked``: cell, q (a short text's columns); ``held``: cell, l (a piece's)."""
    both = asked.select("cell", "q", F.lit(None).cast(held.schema["l"].dataType).alias("l")).union(held.select("cell", F.lit(None).cast(asked.schema["q"].dataType), "l"))
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = block = None
        texts: list[pa.Array] = []
        for batch in batches:
            cells, short = batch.column(0).to_pylist(), batch.column(1).is_valid().to_pylist()
            at = 0
            while at < len(cells):
                to = at
                while to < len(cells) and cells[to] == cells[at] and short[to] == short[at]:
                    to += 1
                if cells[at] != cell:
                    cell, block, texts = cells[at], None, []
                if short[at]:
                    texts.append(batch.column(1).slice(at, to - at))
                elif texts:
                    block = block or Block(pa.concat_arrays(texts), nucleotide, mutual)
                    for q, i, l, j, start, mismatch in block.places(batch.column(2).slice(at, to - at), size):
                        i, j = pa.array(i), pa.array(j)
                        columns = {k: c.take(i) for k, c in q.items() if k in names} | {k: c.take(j) for k, c in l.items() if k in names}
                        columns |= {"start": pa.array(start, pa.int32()), "mismatch": pa.array(mismatch, pa.int32())}
                        yield pa.RecordBatch.from_arrays([columns[k] for k in names], names)
                at = to

    return both.repartitionById(parts, F.col("cell") % parts).sortWithinPartitions("cell", F.col("q").isNull()).mapInArrow(run, schema)


def fitting(shorts: DataFrame, longs: DataFrame, keep: Column, nucleotide: bool = True, circular: bool = False, mutual: bool = False, shorter: bool = False) -> DataFrame:
    """(s_key, form, l_key, n, m, start, mismatch) of the places of ``shorts`` (s_key, form, s, most) in ``longs`` (l_key, l) within ``most`` mismatches.

    There is one row for each s_key and form, and for each l_key; other columns come along with the
    places. No place is longer than its long text (n <= m), or as long (``shorter``, n < m); ``keep`` bounds the two lengths
    further. Nothing is sent where no short text is short enough for any long one.
    With ``mutual``, ``coding.mutual_match`` tells in place of the mismatches whether a text fits.
    """
    texts = longs.where("length(l) > 0").withColumn("m", F.length("l"))
    widest, letters = texts.agg(F.max("m"), F.sum("m")).first()
    once = shorts.where(F.length("s").between(1, (widest or 0) - shorter)).withColumn("n", F.length("s")).withColumn("most", F.col("most").cast("int"))
    longest, weight = once.agg(F.max("n"), F.sum(_weight(nucleotide))).first()
    if longest is None:
        once, texts, letters = once.where("false"), texts.where("false"), 0
    longest, letters = longest or 1, letters or 0
    if circular:
        texts = texts.withColumn("l", F.concat("l", F.left("l", F.lit(longest - 1))))
    size = max(PIECE, longest)
    blocks, cores = int((weight or 0) // BLOCK) + 1, shorts.sparkSession.sparkContext.defaultParallelism
    slices = max(letters // SLICE + 1, min(2 * cores // blocks, letters // LEAST) + 1)
    held = pieces(texts, longest, size, "l").drop("n")
    schema = StructType([f for f in once.schema if f.name not in ("s", "most")] + [f for f in texts.schema if f.name != "l"] + [StructField(c, IntegerType()) for c in ("start", "mismatch")])
    number = lambda n, *columns: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = once.select(F.struct(*once.columns).alias("q"), number(blocks, "s_key", "form").alias("block"), every(slices).alias("slice"))
    sent = held.select(F.struct(*held.columns).alias("l"), number(slices, "l_key", "number").alias("slice"), every(blocks).alias("block"))
    cell = (F.col("block") * slices + F.col("slice")).alias("cell")
    places = _dealt(asked.select(cell, "q"), sent.select(cell, "l"), size, nucleotide, mutual, schema, min(blocks * slices, 16 * max(cores, 16)))
    return places.where(keep & (F.col("n") < F.col("m")) if shorter else keep)


def rows_of(df: DataFrame, key: str) -> DataFrame:
    """(key, id, sequence, times) of the rows of ``df`` (id, sequence): copies together."""
    return df.groupBy(record_key("id", "sequence").alias(key)).agg(F.first("id").alias("id"), F.first("sequence").alias("sequence"), F.count("*").alias("times"))
