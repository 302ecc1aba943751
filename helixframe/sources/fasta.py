"""FASTA and FASTQ readers and writers.

A FASTA record is one text row split at ``\\n>``, so files need not fit a task
(gzip files aren't splittable). Empty records and text before a file's first
header are dropped, sequences upper-cased. FASTQ needs four-line framing, which a
separator can't express: format ``fastq`` (``fastq_source``) reads byte ranges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def fasta_record(value: Column, keep_case: bool = False) -> Column:
    """(id, sequence) of one record's text, with or without its ``>``."""
    text = F.regexp_replace(value, r"^>", "")
    head = F.trim(F.regexp_replace(F.substring_index(text, "\n", 1), r"\r", ""))
    body = F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + 1, F.length(text))).otherwise("")
    letters = F.regexp_replace(body, r"\s", "")
    return F.struct(head.alias("id"), (letters if keep_case else F.upper(letters)).alias("sequence"))


def line_records(value: Column, keep_case: bool = False) -> Column:
    """(id, sequence) of each sequence line of one record's text; the id stops at the first blank."""
    lines = F.split(F.regexp_replace(value, r"^>", ""), r"\r?\n")
    head = F.regexp_extract(F.get(lines, 0), r"^\s*(\S*)", 1)
    held = F.filter(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.regexp_replace(x, r"\s", "")), lambda x: x != "")
    return F.transform(held, lambda x: F.struct(head.alias("id"), (x if keep_case else F.upper(x)).alias("sequence")))


def _first_of_part(part: Column) -> Column:
    """Whether a row is the first of its file part; rows of a part follow each other in a task.

    Only the parts' hashes go through Python, the texts stay behind.
    """

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        last = None
        for keys in batches:
            held = keys.to_numpy()
            first = np.ones(len(held), bool)
            first[1:] = held[1:] != held[:-1]
            if len(held):
                first[0], last = last is None or held[0] != last, held[-1]
            yield pd.Series(first)

    return run.asNondeterministic()(part)  # so that no filter moves below it


def record_texts(rows: DataFrame) -> DataFrame:
    """(value, file, block) of the records among texts that the reader split at ``\\n>``.

    A file's text before its first header is left out: the first row of its first
    part, unless it starts with the marker. Other parts start behind a separator.
    """
    given = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    marked = given.withColumn("_first", _first_of_part(F.xxhash64("file", "block")))
    return marked.where(F.col("value").startswith(">") | (F.col("block") > 0) | ~F.col("_first")).drop("_first")


def read_fasta(spark: SparkSession, path: str | list[str], drop_empty: bool = True, keep_case: bool = False, one_line_per_record: bool = False, mode: str = "PERMISSIVE", counts: Observation | None = None) -> DataFrame:
    """id, sequence, quality (null), file, rec_idx (rises within a file), _corrupt_record (the letters of a malformed record).

    ``one_line_per_record`` makes every sequence line a record of its own. A
    record is malformed without an id, or with other marks than letters, ``*``, ``-`` and
    ``.``: DROPMALFORMED leaves it out, FAILFAST raises, PERMISSIVE keeps it.
    ``counts`` gets ``n_records`` and ``n_corrupt`` of what was read, those left out too (a job that reads twice, as a sort does, counts twice).
    """
    texts = record_texts(spark.read.option("lineSep", "\n>").text(path)).withColumn("rec_idx", F.monotonically_increasing_id())
    if one_line_per_record:
        parsed = texts.select("file", (F.col("rec_idx")).alias("_at"), F.posexplode(line_records(F.col("value"), keep_case)).alias("_line", "r"))
        parsed = parsed.withColumn("rec_idx", F.monotonically_increasing_id())
    else:
        parsed = texts.select(fasta_record(F.col("value"), keep_case).alias("r"), "file", "rec_idx")
    out = parsed.select("r.id", "r.sequence", F.lit(None).cast("string").alias("quality"), "file", "rec_idx")
    out = out.where("sequence <> ''") if drop_empty else out
    good = F.coalesce((F.col("id") != "") & F.col("sequence").rlike(r"^[A-Za-z*.\-]*$"), F.lit(False))
    if counts is not None:
        out = out.observe(counts, F.count("*").alias("n_records"), F.count_if(~good).alias("n_corrupt"))
    out = out.withColumn("_corrupt_record", F.when(~good, F.concat(F.lit(">"), "id", F.lit("\n"), "sequence")))
    if mode == "DROPMALFORMED":
        return out.where(good)
    return out.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("malformed FASTA record: "), "id")).cast("boolean"))) if mode == "FAILFAST" else out


def valid_read(head: Column, seq: Column, plus: Column, quality: Column) -> Column:
    """Whether four lines are one record: both markers, known bases, a quality as long as the sequence. Nulls are not."""
    return F.coalesce(head.startswith("@") & seq.rlike("^[ATGCN]+$") & plus.startswith("+") & (F.length(quality) > 0) & (F.length(quality) == F.length(seq)), F.lit(False))


def _listed(spark: SparkSession, path: str) -> list[str]:
    """The files of a path, folder or pattern, as Spark lists them."""
    return list(spark.read.format("text").load(path).inputFiles())


def read_fastq(spark: SparkSession, path: str | list[str], mode: str = "PERMISSIVE", counts: Observation | None = None, range_bytes: int = 64 << 20) -> DataFrame:
    """id, sequence, quality, file, rec_idx (rises within a file), valid, _corrupt_record; files are read in byte ranges, once.

    A broken record has its text in ``_corrupt_record``; DROPMALFORMED leaves it out, FAILFAST raises. ``counts``
    gets ``n_records`` and ``n_corrupt`` of what was read, those left out too (a job that reads twice, as a sort does, counts twice).
    """
    from helixframe.sources.fastq_source import FastqSource

    spark.dataSource.register(FastqSource)
    paths = path if isinstance(path, list) else _listed(spark, path)
    rows = spark.read.format("fastq").option("paths", json.dumps(paths)).option("rangeBytes", range_bytes).option("valid", "true" if mode == "DROPMALFORMED" and counts is None else "any").load()
    if counts is not None:
        rows = rows.observe(counts, F.count("*").alias("n_records"), F.count_if(~F.col("valid")).alias("n_corrupt"))
    out = rows.select("id", "sequence", "quality", "file", F.col("start").alias("rec_idx"), "valid", "_corrupt_record")
    if mode == "DROPMALFORMED":
        return out.where("valid")
    return out.where(F.when(F.col("valid"), True).otherwise(F.raise_error(F.concat(F.lit("malformed FASTQ record: "), "_corrupt_record")).cast("boolean"))) if mode == "FAILFAST" else out


def record_text(width: int = 0) -> Column:
    """FASTA text of (id, sequence, quality), or FASTQ where there is a quality."""
    from helixframe.functions.sequence import wrap

    seq = wrap(F.col("sequence"), width) if width else F.col("sequence")
    return F.when(F.coalesce(F.col("quality"), F.lit("")) == "", F.concat(F.lit(">"), "id", F.lit("\n"), seq)).otherwise(F.concat(F.lit("@"), "id", F.lit("\n"), "sequence", F.lit("\n+\n"), "quality"))


def write_records(df: DataFrame, path: str, width: int = 0, compression: str = "none", mode: str = "errorifexists") -> None:
    """FASTA or FASTQ text; an existing target is refused before anything is read, unless ``mode`` allows it."""
    df.select(record_text(width).alias("value")).write.mode(mode).option("compression", compression).text(path)


def last_per_id(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("rec_idx"))
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def file_kind(path: Column) -> Column:
    """fasta, fastq, genbank or unknown, by a path's suffix (before ``.gz``)."""
    name = F.regexp_replace(F.lower(path), r"\.gz$", "")
    return F.when(name.rlike(r"\.(fa|fas|fasta|fna|faa)$"), "fasta").when(name.rlike(r"\.(fq|fastq)$"), "fastq").when(name.rlike(r"\.(gb|gbk|genbank)$"), "genbank").otherwise("unknown")


def sample_name(file: Column) -> Column:
    """A read file's sample: its name without folder, suffixes and the mark of the pair's side (``_R1``, ``_1``)."""
    stem = F.regexp_replace(F.regexp_replace(file, r"^.*/", ""), r"\.(fq|fastq|fa|fasta)(\.gz)?$", "")
    return F.regexp_replace(stem, r"[._](R?[12])$", "")


def _kinds(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """First letter that is no blank of each file; only the beginnings are read, in tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from helixframe.sources.fastq_source import open_uri

        for batch in batches:
            first = []
            for path in batch["path"]:
                fs, inner = open_uri(path)
                with fs.open_input_stream(inner, compression="gzip" if path.endswith(".gz") else None) as lines:
                    text = b""
                    while not text and (held := lines.read(1 << 12)):
                        text = held.lstrip()
                first.append(text[:1].decode("ascii", "replace"))
            yield pd.DataFrame({"path": batch["path"], "kind": first})

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r.path: r.kind for r in listed.repartition(min(len(paths), 64)).mapInPandas(run, "path string, kind string").collect()}  # one a file, as the listing


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """FASTA or FASTQ by each file's first letter: id, sequence, quality, file. Files of another kind give no rows.

    Only a file's beginning is read to tell its kind, then one reader reads it, once.
    """
    columns = ["id", "sequence", "quality", "file"]
    kinds = _kinds(spark, paths) if (paths := _listed(spark, path)) else {}
    chosen = {k: [p for p in paths if kinds[p] == k] for k in ">@"}
    out = spark.createDataFrame([], "id string, sequence string, quality string, file string")
    if chosen[">"]:
        out = out.unionByName(read_fasta(spark, chosen[">"]).select(columns))
    return out.unionByName(read_fastq(spark, chosen["@"]).select(columns)) if chosen["@"] else out


def read_proteins(spark: SparkSession, path: str) -> DataFrame:
    """FASTA of amino acids; raises on the ambiguous B and on anything but letters."""
    rows = read_fasta(spark, path)
    broken = F.col("sequence").rlike("[^A-Z]|B")
    return rows.withColumn("sequence", F.when(broken, F.raise_error(F.concat(F.lit("not a protein: "), "id"))).otherwise(F.col("sequence")))


def read_dedup(spark: SparkSession, path: str) -> DataFrame:
    """First record of each sequence, shortest first."""
    from helixframe.operators.dedup import first_per_sequence

    return first_per_sequence(read_fasta(spark, path), "rec_idx").orderBy(F.length("sequence"), "rec_idx")
