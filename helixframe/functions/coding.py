"""Degenerate codons, variant expansion per code or bracket, k-mer similarity and small text functions."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions.sequence import IUPAC, bind, bounded, kmers, masks

# Degenerate codons of each amino acid; the families with two codon boxes are listed whole and merged.
DEGENERATE = {
    "A": ["GCN"], "C": ["TGY"], "D": ["GAY"], "E": ["GAR"], "F": ["TTY"], "G": ["GGN"], "H": ["CAY"], "I": ["ATH"], "K": ["AAR"],
    "L": ["YTR", "CTN"], "M": ["ATG"], "N": ["AAY"], "P": ["CCN"], "Q": ["CAR"], "R": ["CGN", "MGR"], "S": ["TCN", "AGY"],
    "T": ["ACN"], "V": ["GTN"], "W": ["TGG"], "Y": ["TAY"],
}
MERGED = {"L": "YTN", "R": "MGN", "S": "WSN", "*": "TRR", "X": "NNN"}


def _product(choices: Column, limit: int | None) -> Column:
    """Every way to take one string from each array, joined; the last array varies fastest."""
    ways = F.aggregate(choices, F.lit(1.0), lambda n, c: n * F.size(c))
    grown = F.aggregate(choices, F.array(F.lit("")), lambda acc, c: F.flatten(F.transform(acc, lambda v: F.transform(c, lambda x: F.concat(v, x)))))
    return bounded(grown, ways, limit)


def _letters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def reverse_translations(protein: Column, limit: int | None = None) -> Column:
    """All degenerate DNA forms of a protein (two for each L, R or S); other letters stand for themselves."""
    table = F.create_map(*[x for a, codons in DEGENERATE.items() for x in (F.lit(a), F.array(*[F.lit(c) for c in codons]))])
    return _product(F.transform(_letters(protein), lambda a: F.coalesce(F.try_element_at(table, a), F.array(a))), limit)


def reverse_translation(protein: Column) -> Column:
    """One degenerate form, codon boxes merged (WSN, YTN, MGN); null if a letter is no amino acid, stop or X."""
    one = {a: c[0] for a, c in DEGENERATE.items()} | MERGED
    table = F.create_map(*[F.lit(x) for pair in one.items() for x in pair])
    codons = F.transform(_letters(protein), lambda a: F.try_element_at(table, a))
    return F.when(~F.exists(codons, lambda c: c.isNull()), F.array_join(codons, ""))


def expand_per_code(s: Column, limit: int | None = None) -> Column:
    """Variants where every occurrence of one ambiguity code takes the same base: RR gives AA and GG."""
    kind = F.array(*[F.struct(F.lit(c).alias("code"), F.array(*[F.lit(b) for b in bases]).alias("bases")) for c, bases in IUPAC.items() if len(bases) > 1])
    here = F.filter(kind, lambda k: F.contains(s, k["code"]))
    ways = F.aggregate(here, F.lit(1.0), lambda n, k: n * F.size(k["bases"]))
    grown = F.aggregate(here, F.array(s), lambda acc, k: F.flatten(F.transform(acc, lambda v: F.transform(k["bases"], lambda b: F.replace(v, k["code"], b)))))
    return bounded(grown, ways, limit)


def expand_brackets(s: Column, limit: int | None = None) -> Column:
    """Variants of A[BC]D: one letter of each bracket; equal brackets move together. Unclosed brackets stay as text."""
    found = F.array_distinct(F.regexp_extract_all(s, F.lit(r"\[[^\]]+\]"), F.lit(0)))
    choices = lambda b: _letters(F.substring(b, F.lit(2), F.length(b) - 2))
    ways = F.aggregate(found, F.lit(1.0), lambda n, b: n * F.size(choices(b)))
    grown = F.aggregate(found, F.array(s), lambda acc, b: F.flatten(F.transform(acc, lambda v: F.transform(choices(b), lambda x: F.replace(v, b, x)))))
    return bounded(F.array_distinct(grown), ways, limit)


def transcribe(s: Column) -> Column:
    return F.translate(s, "Tt", "Uu")


def plain(s: Column) -> Column:
    """Nothing but A, C, G and T."""
    return ~s.rlike("[^ACGT]")


def _compatible(p: Column, q: Column) -> Column:
    return ~F.exists(F.zip_with(p, q, lambda u, v: F.coalesce(u.bitwiseAND(v), F.lit(0))), lambda z: z == 0)


def kmer_similarity(a: Column, b: Column, k: Column | int) -> Column:
    """Distinct k-mers of ``a`` that some k-mer of ``b`` is compatible with (base sets meet), over the larger set's size; 0 without k-mers."""
    x, y = (F.array_distinct(F.transform(kmers(s, k), masks)) for s in (a, b))

    def share(v: Column) -> Column:
        matched = F.size(F.filter(v["x"], lambda p: F.exists(v["y"], lambda q: _compatible(p, q))))
        return F.try_divide(matched.cast("double"), F.greatest(F.size(v["x"]), F.size(v["y"])))

    return F.coalesce(bind(F.struct(x.alias("x"), y.alias("y")), share), F.lit(0.0))


def window_similarities(a: Column, b: Column, k: Column, starts: Column) -> Column:
    """Array of (start, similarity): ``kmer_similarity`` of ``a`` and each window of ``b`` as long that begins at one of ``starts``.

    Two k-mers are compared once a row, not once a window; k-mers of ``b`` are told apart by the first place of an equal one.
    """
    x, y = F.array_distinct(F.transform(kmers(a, k), masks)), F.transform(kmers(b, k), masks)
    places = lambda v: F.transform(v["x"], lambda p: F.array_compact(F.transform(v["y"], lambda q, j: F.when(_compatible(p, q), j + 1))))
    found = lambda v: F.struct(places(v).alias("places"), F.transform(v["y"], lambda q: F.array_position(v["y"], q)).alias("y"), F.greatest(F.length(a) - k + 1, F.lit(0)).alias("n"))

    def share(v: Column, i: Column) -> Column:
        matched = F.size(F.filter(v["places"], lambda at: F.exists(at, lambda j: (j >= i) & (j < i + v["n"]))))
        return F.try_divide(matched.cast("double"), F.greatest(F.size(v["places"]), F.size(F.array_distinct(F.slice(v["y"], i, v["n"])))))

    both = bind(F.struct(x.alias("x"), y.alias("y")), found)
    return bind(both, lambda v: F.transform(starts, lambda i: F.struct(i.alias("start"), F.coalesce(share(v, i), F.lit(0.0)).alias("similarity"))))


def mutual_match(a: Column, b: Column) -> Column:
    """Two strings of one length where one is plain and inside the other's codes, or both are equal."""
    inside = lambda x, y: plain(x) & ~F.exists(F.zip_with(masks(x), masks(y), lambda u, v: F.coalesce(u.bitwiseAND(v), F.lit(0))), lambda z: z == 0)
    return (a == b) | ((F.length(a) == F.length(b)) & (inside(a, b) | inside(b, a)))


def occurs_once(target: Column, primer: Column) -> Column:
    """Exactly one non-overlapping occurrence."""
    return (F.length(primer) > 0) & (F.length(target) - F.length(F.replace(target, primer, F.lit(""))) == F.length(primer))


def circular_end(end: Column, length: Column) -> Column:
    """Ends behind the last base of a circular sequence wrap around."""
    return F.when(end > length, end - length).otherwise(end)


def percent_identity(identical: Column, aligned: Column) -> Column:
    """Percent; null for an empty alignment."""
    return F.try_divide(100.0 * identical, aligned)


# The named entities that are decoded (``&amp;`` last, so that nothing is decoded twice).
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&copy;": "\u00a9", "&reg;": "\u00ae", "&deg;": "\u00b0", "&micro;": "\u00b5",
    "&middot;": "\u00b7", "&ndash;": "\u2013", "&mdash;": "\u2014", "&hellip;": "\u2026", "&amp;": "&",
}


def plain_text(html: Column, numeric: bool = True) -> Column:
    """Tags removed, the named entities of ``ENTITIES`` and (unless told otherwise) numeric ones decoded."""
    out = F.regexp_replace(html, "<[^>]*>", "")
    if numeric:
        number = lambda p: F.when(p.startswith("x") | p.startswith("X"), F.conv(F.substring(p, 2, 8), 16, 10)).otherwise(p).try_cast("int")
        letter = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        parts = F.split(out, "&#")

        def decoded(p: Column) -> Column:
            digits = F.regexp_extract(p, "^([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});", 1)
            n = number(digits)
            good = (digits != "") & n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
            return F.when(F.coalesce(good, F.lit(False)), F.concat(letter(n), F.substring(p, F.length(digits) + 2, F.length(p)))).otherwise(F.concat(F.lit("&#"), p))

        rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), decoded)
        out = F.when(F.contains(out, F.lit("&#")), F.concat(F.get(parts, 0), F.array_join(rest, ""))).otherwise(out)
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def sha3_256(text: Column) -> Column:
    """SHA3-256 digest of the UTF-8 bytes as lowercase hex, which Spark has no function for; null for null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hashlib.sha3_256(t.encode()).hexdigest())

    return run(text)
