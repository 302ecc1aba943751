"""FASTA folders as streams: stateless parsing, first-seen dedup within a watermark, k-mer counts that grow with the folder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from helixframe.operators.pieces import windows
from helixframe.sources.fasta import fasta_record, record_texts


def stream_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, sequence and arrival time of the records of files as they come; text before a file's first header is left out."""
    rows = record_texts(spark.readStream.option("lineSep", "\n>").text(path))
    return rows.select(fasta_record(F.col("value")).alias("r"), F.current_timestamp().alias("seen_at")).select("r.id", "r.sequence", "seen_at").where("sequence <> ''")


def stream_distinct(records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One record of each sequence within the delay; state is dropped behind the watermark."""
    return records.withColumn("digest", F.md5("sequence")).withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["digest"])


class GrowingCounts(StatefulProcessor):
    """Counts of one k-mer over all files so far; each batch that holds the k-mer gives its new counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("counts", "n long, n_files long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        n, files = self.held.get() if self.held.exists() else (0, 0)
        seen: set[int] = set()
        for part in rows:
            n += int(part["n"].sum())
            seen.update(part["file"])
        self.held.update((n, files + len(seen)))
        yield pd.DataFrame({"kmer": [key[0]], "n": [n], "n_files": [files + len(seen)]})

    def close(self) -> None:
        pass


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.groupby(["kmer", "file"], sort=False).size().rename("n").reset_index()


def stream_kmer_counts(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(kmer, n, n_files) of a growing FASTA folder, as a stream in update mode: the counts of each k-mer that a batch adds to, over all files until then.

    K-mers are cut natively and summed by file within each Arrow batch before they reach the state, which keeps two
    numbers a k-mer. A file is read in one batch of the stream, and counts whenever it comes: a late one adds to the same
    counts as one in time. The session's state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    texts = record_texts(spark.readStream.option("lineSep", "\n>").text(path))
    rows = texts.select(F.xxhash64("file").alias("file"), fasta_record(F.col("value")).alias("r")).select("file", F.col("r.sequence").alias("sequence"))
    grams = windows(rows, k).select(F.col("window").alias("kmer"), "file")
    summed = grams.mapInPandas(_summed, "kmer string, file long, n long")
    return summed.groupBy("kmer").transformWithStateInPandas(GrowingCounts(), "kmer string, n long, n_files long", "Update", "None")
