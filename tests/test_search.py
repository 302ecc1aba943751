"""Variants, k-mer similarity, mapping on both strands, flanking primers, overlap filters."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import coding as C
from helixframe.functions import sequence as S
from helixframe.operators import mapping, search, variants


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_variants(spark):
    s = F.col("s")
    assert one(spark, C.reverse_translations(s), s="ML") == ["ATGYTR", "ATGCTN"]
    assert one(spark, C.reverse_translations(s, limit=1), s="ML") is None
    assert one(spark, C.reverse_translation(s), s="MSX*") == "ATGWSNNNNTRR" and one(spark, C.reverse_translation(s), s="M1") is None
    assert one(spark, C.expand_per_code(s), s="RAR") == ["AAA", "GAG"]
    assert sorted(one(spark, C.expand_per_code(s), s="RY")) == ["AC", "AT", "GC", "GT"]
    assert one(spark, C.expand_brackets(s), s="A[BC]D[BC]") == ["ABDB", "ACDC"] and one(spark, C.expand_brackets(s), s="A[B") == ["A[B"]


@pytest.mark.parametrize(("made", "text"), [(S.expand, "N" * 9), (C.reverse_translations, "L" * 17), (C.expand_brackets, "[ABCDEFGHIJ][BCDEFGHIJK][CDEFGHIJKL][DEFGHIJKLM][EFGHIJKLMN][FGHIJKLMNO]")])
def test_too_many_variants(spark, made, text):
    """Refused, not left out; null stays null."""
    with pytest.raises(Exception, match="more than 100000 variants"):
        spark.createDataFrame([(text,)], "s string").select(F.explode(made(F.col("s")))).collect()
    assert spark.createDataFrame([(None,)], "s string").select(F.explode(made(F.col("s")))).collect() == []


def test_small_functions(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, C.kmer_similarity(a, b, 3), a="ACGT", b="ACGA") == 0.5 and one(spark, C.kmer_similarity(a, b, 9), a="A", b="A") == 0.0
    assert one(spark, C.mutual_match(a, b), a="R", b="N") is False and one(spark, C.mutual_match(a, b), a="RN", b="AC") is True
    assert one(spark, C.mutual_match(a, b), a="RN", b="RN") is True
    assert one(spark, C.occurs_once(a, b), a="ACAC", b="AC") is False and one(spark, C.occurs_once(a, b), a="ACG", b="AC") is True
    assert one(spark, C.plain_text(a), a="<b>x &amp;lt; y</b>") == "x &lt; y"
    assert one(spark, C.thousands(a), a=1234567) == "1,234,567"
    assert one(spark, C.circular_end(a, b), a=12, b=10) == 2 and one(spark, C.percent_identity(a, b), a=1, b=0) is None


def meet(x, y):
    return bool(set(S.IUPAC[x]) & set(S.IUPAC[y]))


@pytest.mark.parametrize("low", [4, 13])
def test_map_pairs(spark, low):
    """Short pieces take the nested loop; from 13 letters on, plain pairs meet through seeds."""
    rng = random.Random(9)
    q = [(k, "".join(rng.choices("ACGTN", [9, 9, 9, 9, low == 4], k=rng.randint(low, low + 3)))) for k in range(6)]
    r = [(k + 100, "".join(rng.choices("ACGTR", [9, 9, 9, 9, 1], k=rng.randint(low + 1, low + 16)))) for k in range(6)]
    for k, (_, s) in enumerate(q[:4]):
        t = s if k % 2 else S.reverse_complement_text(s)
        r.append((200 + k, t[5:] + "GATTACA" + t[:5] if k < 2 else "CC" + t[:1] + "T" + t[2:] + "A" * k))
    q.append((50, r[-1][1] + "GG"))
    frames = [spark.createDataFrame(x, "id int, sequence string") for x in (q, r)]
    for circular in (False, True):
        got = {(x.short_id, x.long_id, x.start, x.end, x.mismatch, x.strand) for x in search.map_pairs(*frames, 0.7, 0.2, circular=circular).collect()}
        want = set()
        for (qi, a), (ri, b) in itertools.product(q, r):
            turn = (2 * len(a) > len(b) and len(a) > len(b)) if circular else len(a) > len(b)
            si, s, li, t = (ri, b, qi, a) if turn else (qi, a, ri, b)
            if len(s) / len(t) < 0.2:
                continue
            n, text = len(s), t + t[: len(s) - 1] if circular else t
            hits = {}
            for strand, x in (("+", s), ("-", S.reverse_complement_text(s))):
                hits[strand] = [(i + 1, m) for i in range(len(text) - n + 1) if (m := sum(not meet(*p) for p in zip(x, text[i : i + n], strict=True))) <= n - round(0.7 * n)]
            best = min((m for _, m in hits["+"]), default=99)
            for i, m, d in [(*h, "+") for h in hits["+"]] + [(*h, "-") for h in hits["-"] if h[1] < best]:
                end = i + n - 1
                want.add((si, li, i, end - len(t) if circular and end > len(t) else end, m, d))
        assert got == want and want
    protein = spark.createDataFrame([(1, "MKV")], "id int, sequence string"), spark.createDataFrame([(2, "AMKVA")], "id int, sequence string")
    assert [(x.start, x.strand) for x in search.map_pairs(*protein, 1.0, nucleotide=False).collect()] == [(2, ".")]


def test_repeated_and_null_rows(spark):
    q = spark.createDataFrame([(1, "ACGTACGTACGTAC"), (1, "ACGTACGTACGTAC"), (None, "ACGTACGTACGTAC"), (2, None), (3, "")], "id int, sequence string")
    r = spark.createDataFrame([(7, "TTACGTACGTACGTACTT"), (8, None)], "id int, sequence string")
    assert sorted(((x.short_id, x.start) for x in search.map_pairs(q, r, 1.0).collect()), key=str) == [(1, 3), (1, 3), (None, 3)]
    assert search.map_pairs(q.limit(0), r).count() == 0 and search.mutual_windows(q, r.limit(0)).count() == 0
    assert sorted(((x.query_id, x.start) for x in mapping.map_queries(q, r, 0, strands=False).collect()), key=str) == [(1, 3), (1, 3), (None, 3)]


def test_map_queries_short_and_ambiguous(spark):
    q = [(1, "A"), (2, "ACGTACGT"), (3, "ACRTNCGT"), (4, "GGGTTTGGGTTTGGG"), (5, "AC")]
    r = [(10, "TTACGTACGATTGGGTTTGGATTTGGG"), (11, "ACGTNCGT"), (12, "A")]
    got = {(x.query_id, x.ref_id, x.start, x.mismatch) for x in mapping.map_queries(*[spark.createDataFrame(x, "id int, sequence string") for x in (q, r)], 1, strands=False).collect()}
    want = {(a, b, i + 1, d) for (a, s), (b, t) in itertools.product(q, r) for i in range(len(t) - len(s) + 1) if (d := sum(not meet(*p) for p in zip(s, t[i : i + len(s)], strict=True))) <= 1}
    assert got == want and {x[0] for x in got} == {1, 2, 3, 4, 5}


def test_windows(spark):
    df = spark.createDataFrame([("AACGTAA", "ACGT")], "a string, b string")
    assert [(x.start, x.end, x.similarity) for x in search.map_windows(df, "a", "b", 0.9).collect()] == [(2, 5, 1.0)]
    q, r = (spark.createDataFrame([(1, s)], "id int, sequence string") for s in ("RN", "AACR"))
    assert sorted(x.start for x in search.mutual_windows(q, r).collect()) == [1, 2]


def test_flanking(spark):
    rng = random.Random(2)
    s = "".join(rng.choices("ACGT", k=90))
    rows = search.flanking_primers(spark.createDataFrame([("t", s)], "id string, sequence string"), 35, 55, 12, -100.0, 200.0).collect()
    assert rows and all(s[x.start - 1 : x.end] == x.primer and s.count(x.primer) == 1 for x in rows)
    assert all(x.end < 35 if x.position == "upstream" else x.start > 55 for x in rows)


def test_overlaps(spark):
    rng = random.Random(5)
    spans = sorted({(a := rng.randint(1, 60), a + rng.randint(2, 14)) for _ in range(30)})
    df = spark.createDataFrame([("x", "+", a, b) for a, b in spans] + [("x", "-", 1, 5)], "id string, strand string, start int, end int")
    got = {(r.strand, r.start, r.end) for r in search.keep_longer_overlaps(df).collect()}
    want = {("-", 1, 5)}
    for a, b in spans:
        other = next(((c, d) for c, d in spans if (c, d) != (a, b) and a <= d and b >= c), None)
        want.add(("+", *((a, b) if other is None or b - a > other[1] - other[0] else other)))
    assert got == want


def test_variant_rows(spark):
    rows = lambda texts, choices, **k: [(r.id, r.number, r.variant) for r in variants.variant_rows(spark.createDataFrame(list(enumerate(texts)), "id int, s string"), choices, **k).orderBy("id", "number").collect()]
    s = F.col("s")
    assert rows(["RY", "", None, "A-"], variants.iupac_choices(s)) == [(0, 0, "AC"), (0, 1, "AT"), (0, 2, "GC"), (0, 3, "GT"), (1, 0, ""), (3, 0, "A-")]
    assert rows(["RY", "A-"], variants.iupac_choices(s, strict=True), first_fastest=True) == [(0, 0, "AC"), (0, 1, "GC"), (0, 2, "AT"), (0, 3, "GT")]
    assert rows(["L"], variants.codon_choices(s)) == [(0, 0, "YTR"), (0, 1, "CTN")]
    many = variants.variant_rows(spark.createDataFrame([("N" * 9,)], "s string"), variants.iupac_choices(s))
    assert many.select("variant").distinct().count() == 4**9 == many.agg(F.max("number")).first()[0] + 1
    got = variants.bracket_rows(spark.createDataFrame([("A[BC]D[EF][BC]",), (None,), ("x",)], "s string"), "s").collect()
    assert [(r.s, r.variant) for r in sorted(got, key=lambda r: (r.s, r.number))] == [("A[BC]D[EF][BC]", v) for v in ("ABDEB", "ABDFB", "ACDEC", "ACDFC")] + [("x", "x")]
    with pytest.raises(Exception, match="more than 2"):
        variants.variant_rows(spark.createDataFrame([("N" * 40,)], "s string"), variants.iupac_choices(s)).collect()
    assert one(spark, S.expand(F.col("s"), strict=True), s="R-") == [] and one(spark, S.expand(F.col("s")), s="R-") == ["A-", "G-"]


def test_overlaps_of_mixed_lengths(spark):
    rng = random.Random(9)
    spans = [("x", rng.choice("+-"), a := rng.randint(1, 400), a + rng.choice([0, 1, 3, 8, 40, 300])) for _ in range(150)] + [("x", "+", 1, 5000)]
    df = spark.createDataFrame(spans, "id string, strand string, start long, end long")
    got = {tuple(r) for r in search.keep_longer_overlaps(df).collect()}
    want = set()
    for i, d, a, b in set(spans):
        other = sorted((x, y) for _, e, x, y in set(spans) if e == d and (x, y) != (a, b) and x <= b and y >= a)
        want.add((i, d, a, b) if not other or b - a > other[0][1] - other[0][0] else (i, d, *other[0]))
    assert got == want


@pytest.mark.parametrize("longer", [True, False])
def test_find_orfs(spark, longer):
    rng = random.Random(2)
    texts = [(k, "".join(rng.choices("ACGT", k=rng.randint(0, 120)))) for k in range(25)]
    got = sorted(tuple(r) for r in search.find_orfs(spark.createDataFrame(texts, "id long, sequence string"), longer_only=longer).collect())
    want = set()
    for k, t in texts:
        frames = set()
        for d, s in (("+", t), ("-", t[::-1].translate(str.maketrans("ACGT", "TGCA")))):
            for i in range(len(s) - 2):
                stop = next((j for j in range(i, len(s) - 2, 3) if s[j : j + 3] in ("TAA", "TAG", "TGA")), None)
                if s[i : i + 3] in ("ATG", "TTG", "CTG", "GTG") and stop is not None:
                    frames.add((d, i + 1, stop + 3, s[i : stop + 3]) if d == "+" else (d, len(s) - stop - 2, len(s) - i, s[i : stop + 3]))
        for f in frames:
            other = min(((x, y, g) for g in frames if g[0] == f[0] and g != f and (x := g[1]) <= f[2] and (y := g[2]) >= f[1]), default=None) if longer else None
            want.add((k, *(f if other is None or len(f[3]) > len(other[2][3]) else other[2])))
    assert got == sorted((k, d, a, b, b - a + 1, s) for k, d, a, b, s in want)


def test_cover_and_layout(spark):
    df = spark.createDataFrame([("g", "a", "ACGTA"), ("g", "b", "CGT"), ("g", "c", "TTT")], "grp string, id string, sequence string")
    assert sorted(r.id for r in search.cover_dedup(df, "grp").collect()) == ["a", "c"]
    files = spark.createDataFrame([("s", "1", 1, 4), ("s", "2", 2, 4), ("t", "1", 0, 3), ("u", "1", 1, 2), ("u", "2", 1, 3)], "sample string, file string, n_matches int, n_reads int")
    assert {r["sample"]: r.layout for r in search.sample_layout(files).collect()} == {"s": "PE", "t": "SE", "u": "UNEQUAL"}
