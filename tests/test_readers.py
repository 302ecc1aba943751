"""Readers over files larger than a split, with text before the first header, and what they write."""

import gzip

import pytest
from pyspark.sql import functions as F

from helixframe.operators import dedup
from helixframe.sources import fasta, flatfiles
from helixframe.streaming import records


@pytest.fixture
def split_at(spark):
    def at(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield at
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def wrapped(k, end="\n"):
    s = "ACGTN"[k % 5] * (k % 90 + 1)
    return f">r{k} x>y{end}" + "".join(s[i : i + 30] + end for i in range(0, len(s), 30)), (f"r{k} x>y", s)


@pytest.mark.parametrize("size", [97, 20_000, 1 << 27])
def test_fasta_splits(spark, tmp_path, split_at, size):
    """Every record of plain, gzipped and CRLF files comes once; text before the first header never."""
    expected, count = [], 300 if size < 1000 else 2000
    for name, junk, end in (("a.fasta", "", "\n"), ("b.fasta", "; note\nACGT\n", "\n"), ("c.fasta", "", "\r\n"), ("d.fasta.gz", "junk\n", "\n"), ("e.fasta", "only junk\n", "")):
        rows = [wrapped(k, end) for k in range(count)] if end else []
        text = (junk + "".join(t for t, _ in rows)).encode()
        (tmp_path / name).write_bytes(gzip.compress(text) if name.endswith("gz") else text)
        expected += [(name, *r) for _, r in rows]
    split_at(size)
    rows = fasta.read_fasta(spark, str(tmp_path)).select(F.substring_index("file", "/", -1).alias("f"), "id", "sequence", "rec_idx").collect()
    assert sorted((r.f, r.id, r.sequence) for r in rows) == sorted(expected)
    ordered = [r.id for r in sorted(rows, key=lambda r: r.rec_idx) if r.f == "a.fasta"]
    assert ordered == [i for f, i, _ in expected if f == "a.fasta"]


def test_small_files_in_one_task(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"{k}.fasta").write_text(f"junk {k}\n>i{k}\nAC\n>j{k}\nGG\n")
    rows = fasta.read_fasta(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() < 40
    assert sorted(r.id for r in rows.collect()) == sorted(f"{c}{k}" for k in range(40) for c in "ij")


@pytest.mark.parametrize("size", [60, 1 << 27])
def test_genbank_and_fastq_splits(spark, tmp_path, split_at, size):
    (tmp_path / "a.gb").write_text("".join(f"LOCUS       p{k}   4 bp    DNA     circular SYN 05-MAR-2020\nORIGIN\n        1 ac{'gt'[k % 2]}t\n//\n" for k in range(50)))
    (tmp_path / "a.fastq").write_text("".join(f"@r{k}\nACGT\n+\nIIII\n" for k in range(200)))
    split_at(size)
    assert {(r["name"], r.sequence) for r in flatfiles.read_genbank(spark, str(tmp_path / "a.gb")).collect()} == {(f"p{k}", f"ac{'gt'[k % 2]}t") for k in range(50)}
    assert sorted(r.id for r in fasta.read_fastq(spark, str(tmp_path / "a.fastq")).where("valid").collect()) == sorted(f"r{k}" for k in range(200))


def test_dialects(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">p q\nacG\n\nTTa\n>\nAC\n>w\nA1\n>empty\n>z\nGG\n")
    read = lambda **k: [(r.id, r.sequence) for r in fasta.read_fasta(spark, str(tmp_path), **k).orderBy("rec_idx").collect()]
    assert read() == [("p q", "ACGTTA"), ("", "AC"), ("w", "A1"), ("z", "GG")]
    assert read(keep_case=True)[0] == ("p q", "acGTTa")
    assert read(one_line_per_record=True) == [("p", "ACG"), ("p", "TTA"), ("", "AC"), ("w", "A1"), ("z", "GG")]
    assert read(mode="DROPMALFORMED") == [("p q", "ACGTTA"), ("z", "GG")]
    assert ("empty", "") in read(drop_empty=False)
    with pytest.raises(Exception, match="malformed FASTA"):
        read(mode="FAILFAST")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text("junk\n>p\nAC\n>q\nac\n>r\nGG\n")
    seen = records.stream_distinct(records.stream_fasta(spark, str(tmp_path / "in")))
    query = seen.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.sequence for r in spark.table("seen").collect()) == ["AC", "GG"]


def test_first_per_sequence(spark):
    rows = spark.createDataFrame([(1, "A"), (1, "A"), (2, "A"), (3, None), (4, None), (5, "")], "n int, sequence string")
    assert sorted((r.n, r.sequence or "-") for r in dedup.first_per_sequence(rows, "n").collect()) == [(1, "A"), (3, "-"), (5, "-")]


def test_names(spark):
    paths = [("/x/s1_R1.fastq.gz", "fastq", "s1"), ("s1_R2.fq", "fastq", "s1"), ("/y/g.FA", "fasta", "g.FA"), ("p.gbk", "genbank", "p.gbk"), ("p.txt", "unknown", "p.txt")]
    got = spark.createDataFrame([(p,) for p, _, _ in paths], "p string").select("p", fasta.file_kind(F.col("p")), fasta.sample_name(F.col("p"))).collect()
    assert [tuple(r) for r in got] == paths


def test_no_overwriting(spark, tmp_path):
    rows = spark.createDataFrame([("a", "ACGT", None)], "id string, sequence string, quality string")
    fasta.write_records(rows, str(tmp_path / "o"))
    with pytest.raises(Exception, match="(?i)already exists"):
        fasta.write_records(rows, str(tmp_path / "o"))
    fasta.write_records(rows, str(tmp_path / "o"), mode="overwrite")
    assert fasta.read_fasta(spark, str(tmp_path / "o")).count() == 1
