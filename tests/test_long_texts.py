"""Frames and k-mers of long texts, and of records that repeat or have no id."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import frames, kmers, mapping, search, tables
from helixframe.operators.pieces import pieces, windows

BACK = str.maketrans("ACGT", "TGCA")


def brute_frames(s):
    for d, t in (("+", s), ("-", s[::-1].translate(BACK))):
        following = {}
        for i in range(len(t) - 3, -1, -1):
            codon = t[i : i + 3]
            if codon in ("TAA", "TAG", "TGA"):
                following[i % 3] = i
            elif codon in ("ATG", "TTG", "CTG", "GTG") and i % 3 in following:
                yield d, i + 1, following[i % 3] + 3


def brute_orfs(s):
    """Distinct frames in forward coordinates with their sequences."""
    for d, a, b in set(brute_frames(s)):
        t = s if d == "+" else s[::-1].translate(BACK)
        yield (d, a, b, t[a - 1 : b]) if d == "+" else (d, len(s) - b + 1, len(s) - a + 1, t[a - 1 : b])


def records(seed, sizes, letters="ACGT"):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(letters, k=k)) for k in sizes]
    ids = [None, 1, 1, 2, None, 3, 1]
    rows = [(ids[k % len(ids)], t) for k, t in enumerate(texts)]
    return [*rows, rows[1], rows[1], (5, None), (6, ""), (None, "AC")]


@pytest.mark.parametrize("block", [1 << 20, 300, 37])
def test_frames_by_row(spark, monkeypatch, block):
    monkeypatch.setattr(frames, "BLOCK", block)
    rows = records(1, [0, 5, 6, 90, 255, 256, 257, 258, 700, 1500])
    df = spark.createDataFrame(rows, "id int, sequence string")
    got = Counter(tuple(r) for r in mapping.open_reading_frames(df).collect())
    assert got == Counter((i, *f) for i, s in rows for f in brute_frames(s or ""))
    found = Counter((r.id, r.strand, r.start, r.end, r.sequence) for r in search.find_orfs(df, longer_only=False).collect())
    assert found == Counter((i, *f) for i, s in rows for f in brute_orfs(s or ""))


def test_frames_without_stops_for_long(spark, monkeypatch):
    monkeypatch.setattr(frames, "BLOCK", 64)
    text = "ATG" + "GCC" * 400 + "ATG" + "GCC" * 200 + "TAA" + "ATG" + "GCC" * 100
    got = sorted((r.start, r.end) for r in mapping.open_reading_frames(spark.createDataFrame([(1, text)], "id int, sequence string")).where("strand = '+'").collect())
    assert got == [(1, 1809), (1204, 1809)]


def test_million_letters(spark):
    text = "".join(random.Random(3).choices("ACGT", k=1_000_000))
    df = spark.createDataFrame([(None, text)], "id int, sequence string")
    began = time.time()
    rows = search.find_orfs(df, longer_only=False).agg(F.count("*").alias("n"), F.sum(F.xxhash64("strand", "start", "end").cast("decimal(38,0)")).alias("h"), F.max("n").alias("longest"), F.sum((F.length("sequence") == F.col("n")).cast("int")).alias("whole")).first()
    assert time.time() - began < 60
    want = set(brute_frames(text))
    assert rows.n == rows.whole == len(want) and rows.longest == max(b - a + 1 for _, a, b in want)
    assert kmers.kmer_counts(df, 9).where("n_ids <> 1").count() == 0


@pytest.mark.parametrize("k", [1, 4, 11, 31, 32, 300])
def test_kmer_counts(spark, k):
    rows = records(2, [3, 11, 60, 256, 257, 600, 1300], "ACGN" if k < 32 else "ACGT")
    total, held = Counter(), Counter()
    for _, s in rows:
        found = [s[i : i + k] for i in range(len(s) - k + 1)] if s else []
        total.update(found)
        held.update(set(found))
    got = {r.kmer: (r.n, r.n_ids) for r in kmers.kmer_counts(spark.createDataFrame(rows, "id int, sequence string"), k).collect()}
    assert got == {x: (n, held[x]) for x, n in total.items()}


@pytest.mark.parametrize("k", [3, 8, 33])
def test_filters_tell_records_by_row(spark, k):
    rows = records(4, [3, 9, 40, 40, 80, 300, 700], "ACGT")
    rows += [(1, "T" * 40), (1, "G" * 12 + "T" * 2), (None, "TTTAAACCCGGG" * 4), (None, "TTTAAACCCGGG" * 3), (8, "AGCTTCGA" * 5), (8, "AGCTTCGA" * 5)]
    grams = [[s[i : i + k] for i in range(len(s) - k + 1)] if s else [] for _, s in rows]
    holders, total = Counter(x for g in grams for x in set(g)), Counter(x for g in grams for x in g)
    df = spark.createDataFrame(rows, "id int, sequence string")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    for got, want in ((kmers.sharing_kmer(df, k), [r for r, g in zip(rows, grams, strict=True) if any(holders[x] > 1 for x in g)]), (kmers.repeated_kmer(df, k), [r for r, g in zip(rows, grams, strict=True) if any(total[x] > 1 for x in g)])):
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_a_record_that_shares_nothing_is_dropped_though_its_id_is_kept(spark):
    rows = [(1, "T" * 13), (1, "ACGTACGTACGTA"), (2, "ACGTACGTACGTT"), (None, "ACGTACGTACGTC")]
    got = sorted(r.sequence for r in kmers.sharing_kmer(spark.createDataFrame(rows, "id int, sequence string"), 11).collect())
    assert got == sorted(s for _, s in rows[1:])


def test_pieces_hold_every_letter_once(spark):
    text = "".join(random.Random(5).choices("ACGT\né", k=1000))
    rows = pieces(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, sequence string"), 3, 64).orderBy("number").collect()
    assert "".join(r.piece[:64] for r in rows) == text and {r.n for r in rows} == {1000} and rows[0].piece == text[:67] and rows[-1].piece == text[960:]
    got = [r.window for r in windows(spark.createDataFrame([(1, text)], "id int, sequence string"), 7).orderBy("number", "at").collect()]
    assert got == [text[i : i + 7] for i in range(994)]


def test_intervals_before_the_first_letter(spark):
    seqs = spark.createDataFrame([(1, "ACGTTT")], "id int, sequence string")
    spans = spark.createDataFrame([(1, 0, 3, "a"), (1, -4, 2, "b"), (1, 3, 0, "c"), (1, 5, 9, "d"), (1, 0, 0, "e")], "id int, start int, end int, annotation string")
    assert {r.annotation: r.sequence for r in mapping.extract_intervals(seqs, spans).collect()} == {"a": "ACG", "b": "AC", "c": "CGT", "d": "TT", "e": ""}


def test_last_of_repeated_keys(spark):
    rows = [("a", "x", 9, 1), ("a", "x", 2, 2), ("b", "y", 5, 1)]
    got = tables.merge_counts(spark.createDataFrame(rows, "key string, sample string, n int, at int"), ["x", "y"], order="at").collect()
    assert {tuple(r) for r in got} == {("a", 2, 0), ("b", 0, 5)}


@pytest.mark.parametrize(("pattern", "most"), [("ATACN", 1), ("ATACM", 0), ("ACGTRYACGTNN", 3), ("A" * 5 + "CGTN" * 20, 9), ("ACGT" * 9, 0), ("G", 0), ("ACXG", 1), ("ACG", 3)])
def test_tolerant_search(spark, pattern, most):
    rng = random.Random(len(pattern))
    rows = [(k, "".join(rng.choices("ACGTNRX", [9, 9, 9, 9, 1, 1, 1], k=n))) for k, n in enumerate([0, 3, 40, 255, 256, 300, 900])]
    rows += [(9, ("ACGT" * 100)[: 30 + len(pattern)] + pattern.replace("N", "A").replace("R", "G") + "TT"), (10, None)]
    mask = S.MASK
    fits = lambda s, i: sum(not mask.get(a, 0) & mask.get(b, 0) for a, b in zip(pattern, s[i:], strict=False)) <= most
    want = sorted((k, i + 1) for k, s in rows if s for i in range(len(s) - len(pattern) + 1) if fits(s, i))
    df = spark.createDataFrame(rows, "id int, sequence string")
    assert sorted(tuple(r) for r in mapping.map_one(df, pattern, most).collect()) == want
    held = df.where("length(sequence) > 0").select("id", F.explode(S.hamming_hits(F.col("sequence"), F.lit(pattern), most)))
    assert sorted(tuple(r) for r in held.collect()) == want
