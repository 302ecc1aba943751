"""From raw documents to packed training sequences: five stages, each a table in the shared folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm import exact_dedup, ngram_join, packing, quality_rules, secret_scan
from helixframe.llm.store import documents, release, stash, temporary

END_ID = 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of policy v2, repeated rows each; null and empty texts don't pass. Other columns may have any names."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0)
    measured = quality_rules.measurements(docs.select("doc_id", "text", rest.alias("_rest")), keep=("text", "_rest"))
    passed = quality_rules.ledger(measured).where(quality_rules.passes("v2"))
    return passed.select(*[F.col(f"_rest.`{c}`") if c in others else F.col(c) for c in docs.columns])


def _whole(docs: DataFrame) -> Column:
    """A document's columns in one, so that no other name meets theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal texts: the one with the largest id, null ids last; of rows that repeat with their id, one."""
    digest = F.sha2(exact_dedup.normalised(F.col("text")), 256)
    kept = exact_dedup.classes(docs).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest")).distinct()
    rows = docs.select(F.col("doc_id").alias("own"), digest.alias("sha"), _whole(docs)).join(kept, F.col("own").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("digest")), "left_semi")
    turn = F.row_number().over(Window.partitionBy("own", "sha").orderBy("_doc.text"))
    return rows.withColumn("turn", turn).where("turn = 1").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similarity 0.8 or more on five-word shingles: the one with the smallest id (null ids last), of repeated rows one. Texts without words stay.

    Rows are told by id and text, so texts of a repeated or null id are documents of their own.
    """
    key = F.struct(F.col("doc_id").isNull().alias("null"), F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"), F.xxhash64("text").alias("text"))
    found = ngram_join.join(docs.select(key.alias("key"), "text"), ngram_join.Spec(size=5, num=80, den=100), id_col="key")
    kept = found.where(F.col("key") == F.col("component_id")).select(F.col("key").alias("stays"), F.col("set").isNull().alias("wordless")).distinct()
    rows = docs.select(key.alias("key"), _whole(docs)).join(kept, F.col("key") == F.col("stays"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy("_doc.text"))
    return rows.withColumn("turn", turn).where("wordless OR turn = 1").select("_doc.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret masked; ``n_chars`` follows. Every row stays, null texts as they are."""
    return secret_scan.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences; null and empty texts are an end id."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=END_ID)


STAGES = [("quality", quality), ("exact_duplicates", exact_duplicates), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", pack)]
#: SQL can't express the later stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; a stage's table and those of its operator go once the next one is written."""
    docs, before = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with temporary(spark) as keep:
            docs = keep(stash(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if before is not None:
            release(before)
        before = docs
    return docs
