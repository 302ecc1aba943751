"""FASTQ in byte ranges, broken records with their text and counts, files told apart by their beginnings."""

import gzip
import json

from pyspark.sql import Observation

from helixframe.sources import fasta


def reads(n):
    lines = []
    for k in range(n):
        seq = "ACGTN"[k % 5] * (20 + k % 7)
        lines += [f"@r{k} x", seq, "+", ("@" if k % 3 else "I") * (len(seq) - (k % 10 == 0))]
    return "\n".join(lines) + "\n"


def test_ranges_and_counts(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(reads(300))
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(reads(50).encode()))
    counts = Observation("reads")
    rows = fasta.read_fastq(spark, str(tmp_path), "DROPMALFORMED", counts, range_bytes=700).collect()
    assert len(rows) == 270 + 45 and all(r._corrupt_record is None and r.valid for r in rows)
    assert counts.get == {"n_records": 350, "n_corrupt": 35}
    broken = fasta.read_fastq(spark, str(tmp_path / "a.fastq"), range_bytes=700).where("NOT valid").orderBy("rec_idx").collect()
    assert [r._corrupt_record.split("\n")[0] for r in broken] == [f"@r{k} x" for k in range(0, 300, 10)] and all(r._corrupt_record.count("\n") == 3 for r in broken)


def test_filter_and_columns_reach_the_reader(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(reads(100))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("fastq").option("paths", json.dumps([str(tmp_path / "a.fastq")])).option("columns", "id,valid").option("pushdown", "true").load()
        assert df.columns == ["id", "valid"]
        chosen = df.where("valid = true")
        assert chosen.count() == 90
        plan = chosen._jdf.queryExecution().executedPlan().toString()
        assert "BatchScan fastq" in plan and "Filter " not in plan
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_broken_fasta_is_kept_counted_or_left_out(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a\nACGT\n>\nAC\n>c\nA1\n>d\nacg\n")
    counts = Observation("fasta")
    got = sorted(fasta.read_fasta(spark, str(tmp_path / "a.fa"), counts=counts).collect(), key=lambda r: r.rec_idx)
    assert [(r.id, r._corrupt_record) for r in got] == [("a", None), ("", ">\nAC"), ("c", ">c\nA1"), ("d", None)]
    assert counts.get == {"n_records": 4, "n_corrupt": 2}
    assert [r.id for r in fasta.read_fasta(spark, str(tmp_path / "a.fa"), mode="DROPMALFORMED").orderBy("rec_idx").collect()] == ["a", "d"]


def test_each_file_is_read_by_its_own_reader(spark, tmp_path):
    (tmp_path / "x.txt").write_text("\n\n>a\nACGT\n")
    (tmp_path / "y y.txt").write_text(" \n@b\nAC\n+\nII\n")
    (tmp_path / "z.txt").write_text("nothing\n")
    (tmp_path / "w.gz").write_bytes(gzip.compress(b">c\nGG\n"))
    (tmp_path / "empty.txt").write_text("")
    df = fasta.read_sequences(spark, str(tmp_path))
    assert sorted((r.id, r.sequence, r.quality) for r in df.collect()) == [("a", "ACGT", None), ("b", "AC", "II"), ("c", "GG", None)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and plan.count("BatchScan") == 1
