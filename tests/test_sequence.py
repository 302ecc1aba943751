"""Hand-derived results, readers and writers, and brute-force checks of the sequence operators."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import alignment, dedup, kmers, mapping, stats, tables
from helixframe.sources import fasta
from helixframe.sources import tables as table_sources


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_goldens(spark):
    s = F.col("s")
    assert one(spark, S.reverse_complement(s), s="AACRN") == "NYGTT"
    assert one(spark, S.reverse_complement(s, "acgt"), s="ACNG") == "CNGT"
    assert one(spark, S.reverse_complement(s, "acgt", "drop"), s="ACNG") == "CGT"
    assert one(spark, S.expand(s), s="RY") == ["AC", "AT", "GC", "GT"]
    assert one(spark, S.expand(s, first_fastest=True), s="RY") == ["AC", "GC", "AT", "GT"]
    assert one(spark, S.expand(s, limit=3), s="RY") is None
    assert one(spark, S.translate(s), s="ATGAAATAA") == "MK*"
    assert one(spark, S.open_frame(S.translate(s)), s="ATGAAATAA") and one(spark, S.open_frame(S.translate(s)), s="ATGTAAATG") is False
    assert one(spark, S.translate(s, to_stop=True), s="ATGAAATAA") == "MK"
    assert one(spark, S.hamming_hits(s, F.lit("ATACN"), 1), s="ATGCGATACGCTAGCTAGCATCGAT") == [1, 6]
    assert one(spark, S.hamming_hits(s, F.lit("ATACM"), 0), s="ATGCGATACGCTAGCTAGCATCGAT") == []
    assert one(spark, S.max_mismatches(F.length(s), 0.85), s="A" * 10) == 2
    assert one(spark, S.kmers(s, 5), s="ACG") == [] and one(spark, S.kmers(s, 2), s="ACG") == ["AC", "CG"]
    assert one(spark, F.regexp_count(s, F.lit("AA")), s="AAAA") == 2 and one(spark, F.regexp_count(s, F.lit("AAA")), s="AAAAA") == 1


def test_length_stats(spark):
    for lengths, want in (((2, 3, 5), (3, 2, 3.8)), ((5, 3, 2), (3, 2, 3.8)), ((1, 10), (10, 10, 101 / 11))):
        r = stats.length_stats(spark.createDataFrame([("f", x) for x in lengths], "file string, length int"), "file").first()
        assert (r.n50, r.n90) == want[:2] and r.aun == pytest.approx(want[2])
    gc = stats.mean_gc(spark.createDataFrame([("f", "GC"), ("f", "AAAA")], "file string, sequence string"), "file").first().gc_percent
    assert gc == 50.0


def test_kmer_filters(spark):
    df = spark.createDataFrame([("a", "AAAA"), ("b", "CCC")], "id string, sequence string")
    assert [r.id for r in kmers.repeated_kmer(df, 3).collect()] == ["a"] and kmers.sharing_kmer(df, 3).count() == 0


def test_containment(spark):
    df = spark.createDataFrame([("x", "ACGT", 0), ("y", "CG", 1), ("z", "ACGT", 2)], "id string, sequence string, rec_idx int")
    first = dedup.first_per_sequence(df, "rec_idx")
    assert sorted(r.id for r in dedup.drop_contained(first).collect()) == ["x"]
    rng = random.Random(1)
    seqs = ["".join(rng.choices("AC", k=rng.randint(1, 9))) for _ in range(80)]
    got = {r.id for r in dedup.drop_contained(spark.createDataFrame(list(enumerate(seqs)), "id long, sequence string").repartition(7)).collect()}
    assert got == {k for k, s in enumerate(seqs) if not any(len(t) > len(s) and s in t for t in seqs)}


def test_primers_and_intervals(spark):
    df = spark.createDataFrame([("s", "ACGTTTTTGCA", "ABCDEFGHIJK")], "id string, sequence string, quality string")
    r = mapping.amplicons(df, "ACG", "TGC").first()
    assert (r.sequence, r.quality) == ("TTTTT", "DEFGH")
    seqs = spark.createDataFrame([("s", "AAACCGTT")], "id string, sequence string")
    spans = spark.createDataFrame([("s", 2, 4, "f"), ("s", 4, 2, "r")], "id string, start int, end int, annotation string")
    assert {r.annotation: r.sequence for r in mapping.extract_intervals(seqs, spans).collect()} == {"f": "AAC", "r": "GTT"}
    exons = spark.createDataFrame([("t", 21, 30), ("t", 1, 10)], "transcript string, start int, end int")
    assert [(r.start, r.end) for r in mapping.introns(exons).collect()] == [(11, 20)]
    assert one(spark, mapping.anchored(F.col("s"), "AC"), s="TTAC") == "REVERSE"


@pytest.mark.parametrize("sizes", [(9,), (6, 9, 13), (3, 8, 12, 24, 30)])
def test_mapping(spark, sizes):
    rng = random.Random(4)
    q = [(k, "".join(rng.choices("ACGT", k=rng.choice(sizes)))) for k in range(12)]
    r = [(k, "".join(rng.choices("ACGT", k=rng.randint(5, 120)))) for k in range(12)]
    got = {(x.query_id, x.ref_id, x.start, x.mismatch) for x in mapping.map_queries(spark.createDataFrame(q, "id long, sequence string"), spark.createDataFrame(r, "id long, sequence string"), 2, strands=False).collect()}
    want = {(a, b, i + 1, d) for (a, s), (b, t) in itertools.product(q, r) for i in range(len(t) - len(s) + 1) if (d := sum(x != y for x, y in zip(s, t[i:], strict=False))) <= 2}
    assert got == want and want


def test_tables(spark):
    df = spark.createDataFrame([("a", "f1", 1), ("a", "f2", 2), ("b", "f2", 3)], "key string, sample string, n int")
    assert {r.key: (r.f1, r.f2) for r in tables.merge_counts(df, ["f1", "f2"], order="n").collect()} == {"a": (1, 2), "b": (0, 3)}
    df = spark.createDataFrame([("AC", 1), ("ACG", 2), ("TT", 5)], "id string, n int")
    assert {(r.id, r.n) for r in tables.merge_related(df).collect()} == {("ACG", 3), ("TT", 5)}
    df = spark.createDataFrame([("A1", 1), ("A12", 2), ("1", 4), ("xA12y", 8), ("B", 16)], "id string, n int")
    assert {(r.id, r.n) for r in tables.merge_related(df).collect()} == {("xA12y", 15), ("B", 16)}


def test_readers(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("junk\n>s1 d\nACG\nttN\n>s2\nGG\n\n>s3\n")
    got = sorted((r.id, r.sequence) for r in fasta.read_fasta(spark, str(tmp_path / "a.fasta")).collect())
    assert got == [("s1 d", "ACGTTN"), ("s2", "GG")]
    (tmp_path / "a.fastq").write_text("@r1\nACGT\n+\nIIII\n@r2\nACX\n+\nIII\n")
    rows = fasta.read_fastq(spark, str(tmp_path / "a.fastq"))
    assert [(r.id, r.valid) for r in rows.orderBy("rec_idx").collect()] == [("r1", True), ("r2", False)]
    assert fasta.read_fastq(spark, str(tmp_path / "a.fastq"), "DROPMALFORMED").count() == 1
    fasta.write_records(rows.where("valid"), str(tmp_path / "out"))
    assert fasta.read_fastq(spark, str(tmp_path / "out")).first().quality == "IIII"
    (tmp_path / "c.tsv").write_text("a\t3\nb\tx\nc\n")
    assert {r.key: r.n for r in table_sources.read_counts(spark, str(tmp_path / "c.tsv")).collect()} == {"a": 3, "b": 0}


def brute_pairs(s):
    good = {"AU", "UA", "GC", "CG"}
    best = {}

    def go(i, j):
        if i >= j:
            return 0
        if (i, j) not in best:
            best[i, j] = max([go(i + 1, j)] + [1 + go(i + 1, k - 1) + go(k + 1, j) for k in range(i + 1, j + 1) if s[i] + s[k] in good])
        return best[i, j]

    return go(0, len(s) - 1)


def test_alignment_and_folding():
    rng = random.Random(6)
    for _ in range(60):
        a, b = ("".join(rng.choices("ACGT", k=rng.randint(0, 12))) for _ in range(2))
        for local in (False, True):
            score, x, y, *_ = alignment.align_pair(a, b, local=local)
            assert score == sum(-2 if "-" in p else 2 if p[0] == p[1] else -1 for p in zip(x, y, strict=True))
            assert score == alignment.align_pair(b, a, local=local)[0]
            if not local:
                assert (x.replace("-", ""), y.replace("-", "")) == (a, b)
            else:
                assert x.replace("-", "") in a and y.replace("-", "") in b
        s = "".join(rng.choices("ACGU", k=rng.randint(0, 14)))
        n, structure = alignment.fold_rna(s)
        assert n == brute_pairs(s) == structure.count("(") == structure.count(")") and len(structure) == len(s)
        while "()" in (structure := re.sub(r"\.", "", structure)):
            structure = structure.replace("()", "")
        assert structure == ""


def test_added_functions(spark):
    s = F.col("s")
    assert tuple(one(spark, S.base_frequencies(s), s="AATG")) == (0.5, 0.25, 0.25, 0.0) and one(spark, S.base_frequencies(s).a, s="") is None
    assert one(spark, S.numbered_id(s, F.lit(7), 3), s="x") == "x_007" and one(spark, S.numbered_id(s, F.lit(1234), 3), s="x") == "x_1234"
    assert one(spark, S.percent_text(F.lit(0.98765)), s="") == "98.77" and one(spark, S.has_keyword(s, ["b.d", "q"]), s="abcd") is True
    assert one(spark, S.has_keyword(s, []), s="a") is False
    assert S.iupac_regex("AR.") == "A[AG]\\." and one(spark, s.rlike(S.iupac_regex("R.")), s="AC") is False
    from helixframe.functions import coding as C

    assert one(spark, C.plain_text(s), s="<p>a&amp;lt; &#65;&#x2014;&copy;&#; &#99999999;</p>") == "a&lt; A\u2014\u00a9&#; &#99999999;"
    assert one(spark, C.sha3_256(s), s="abc") == "3a985da74fe225b2045c172d6bd390bd855f086e3e9d525b46bfe24511431532"
    assert one(spark, C.expand_per_code(s), s="RRY") == ["AAC", "AAT", "GGC", "GGT"]


def test_long_containment(spark):
    rng = random.Random(8)
    long = ["".join(rng.choices("ACGT", k=200)) for _ in range(20)]
    cut = [t[a : a + n] for t in long for a, n in ((0, 3), (5, 40), (60, 31), (150, 50), (20, 9))] + ["".join(rng.choices("ACGT", k=35)) for _ in range(20)] + ["", long[0][:-1] + "N"]
    texts = long + cut + long[:2] + [None]
    got = sorted((r.sequence or "-") for r in dedup.drop_contained(spark.createDataFrame([(t,) for t in texts], "sequence string")).collect())
    assert got == sorted((t or "-") for t in texts if t is None or not any(x and len(x) > len(t) and t in x for x in texts))


def test_sinks(spark, tmp_path):
    from helixframe.sources import sinks

    df = spark.createDataFrame([("b", 2, None), ("a", 1, "x|y"), ("c", 3, "z" * 60)], "id string, n int, note string")
    sinks.write_table(df, str(tmp_path / "t"), order=["id"])
    lines = [x for f in sorted((tmp_path / "t").glob("part*")) for x in f.read_text().splitlines()]
    assert [x for x in lines if not x.startswith("id\t")] == ["a\t1\tx|y", "b\t2\t", "c\t3\t" + "z" * 60] and lines[0] == "id\tn\tnote"
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_table(df, str(tmp_path / "t"))
    sinks.write_json(df.where("n < 3"), str(tmp_path / "j"))
    assert sorted(spark.read.json(str(tmp_path / "j")).select("id", "n").collect()) == [("a", 1), ("b", 2)]
    sinks.write_markdown(df, str(tmp_path / "m"), most=10)
    text = spark.read.text(str(tmp_path / "m")).collect()
    assert {r.value for r in text} == {"| id  | n   | note       |", "|-----|-----|------------|", "| a   | 1   | x\\|y       |", "| b   | 2   |            |", "| c   | 3   | zzzzzzz... |"}
    assert one(spark, sinks.aligned_text(F.col("a"), F.col("b"), 4), a="AC-GT", b="ATCGT") == "   1 AC-G\n     |. |\n   1 ATCG\n\n   5 T\n     |\n   5 T\n"
    assert one(spark, sinks.family_text(F.array("a", "b"), 2), a="ACG", b="A-G") == "AC\nA-\n\nG\nG"
    places = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.5)], "q int, similarity double")
    assert [r.q for r in sinks.by_similarity(places).collect()] == [2, 1, 3]
