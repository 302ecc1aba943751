"""K-mer counts and filters over texts of any length; records are told by row, not by id.

Texts are read in pieces, so no array of a text's k-mers is made. Plain k-mers of
up to 31 letters are keyed by a number, two bits a letter; others by their text.
Null and empty texts, and texts shorter than k, have no k-mers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.layout import meet
from helixframe.operators.pieces import record_key, windows

_LETTERS, _DIGITS = "ACGT", "0123"


def _code(kmer: Column, k: int) -> tuple[Column, Column]:
    """(number, text) of a k-mer, one of them null."""
    plain = ~kmer.rlike("[^ACGT]") if k <= 31 else F.lit(False)
    number = F.when(plain, F.conv(F.translate(kmer, _LETTERS, _DIGITS), 4, 10).cast("long"))
    return number.alias("code"), F.when(~plain, kmer).alias("odd")


def _text(k: int) -> Column:
    digits = F.lpad(F.conv(F.col("code").cast("string"), 10, 4), k, "0")
    return F.coalesce(F.translate(digits, _DIGITS, _LETTERS), F.col("odd"))


def kmer_counts(df: DataFrame, k: int, id_col: str = "id", sequence: str = "sequence") -> DataFrame:
    """kmer, n (total), n_ids (records that hold it); combined before each shuffle.

    In a record of one piece a k-mer counts where it is first found; only those of
    longer records are told apart by record.
    """
    rows = windows(df.select(F.monotonically_increasing_id().alias("_record"), F.col(sequence).alias("_s")), k, "_s")
    alone = F.col("n") <= max(256, 2 * k)
    first = F.when(alone, (F.instr("piece", F.col("window")) == F.col("at")).cast("int")).otherwise(0)
    keyed = rows.select(*_code(F.col("window"), k), F.when(~alone, F.col("_record")).alias("_record"), first.alias("first"))
    per = keyed.groupBy("code", "odd", "_record").agg(F.count("*").alias("n"), F.sum("first").alias("first"))
    counted = per.groupBy("code", "odd").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_record").isNull(), F.col("first")).otherwise(1)).alias("n_ids"))
    return counted.select(_text(k).alias("kmer"), "n", "n_ids")


def _keyed(df: DataFrame, k: int, id_col: str, sequence: str) -> DataFrame:
    """(_key, code, odd) of every k-mer."""
    rows = windows(df.select(record_key(id_col, sequence).alias("_key"), F.col(sequence).alias("_s")), k, "_s")
    return rows.select("_key", *_code(F.col("window"), k))


def _kept(df: DataFrame, keys: DataFrame, id_col: str, sequence: str) -> DataFrame:
    return meet(df, keys, record_key(id_col, sequence) == F.col("_key"), "left_semi")


def _meeting(rows: DataFrame, kmers: DataFrame) -> DataFrame:
    """Keys of records with one of the k-mers."""
    told = kmers.select(F.col("code").alias("_code"), F.col("odd").alias("_odd"))
    same = F.col("code").eqNullSafe(F.col("_code")) & F.col("odd").eqNullSafe(F.col("_odd"))
    return meet(rows, told, same, "left_semi").select("_key")


def sharing_kmer(df: DataFrame, k: int = 11, id_col: str = "id", sequence: str = "sequence") -> DataFrame:
    """Records that share a k-mer with another record; a copy of a record is another record."""
    rows = _keyed(df, k, id_col, sequence)
    shared = rows.groupBy("code", "odd").agg(F.min("_key").alias("least"), F.max("_key").alias("most")).where("least <> most").select("code", "odd")
    copies = df.where(F.length(sequence) >= k).groupBy(record_key(id_col, sequence).alias("_key")).count().where("count > 1").select("_key")
    return _kept(df, _meeting(rows, shared).union(copies), id_col, sequence)


def repeated_kmer(df: DataFrame, k: int | None = None, id_col: str = "id", sequence: str = "sequence") -> DataFrame:
    """Records with a k-mer whose total count is over one (self repeats count); k is the least length unless given. Empty texts have no k-mers and don't count for it."""
    if k is None:
        k = df.where(F.length(sequence) > 0).agg(F.min(F.length(sequence))).first()[0] or 1
    rows = _keyed(df, k, id_col, sequence)
    often = rows.groupBy("code", "odd").agg(F.count("*").alias("n")).where("n > 1").select("code", "odd")
    return _kept(df, _meeting(rows, often), id_col, sequence)
