"""Variants of ambiguous texts as rows, whatever their number: each is decoded from its own number in mixed radix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.coding import DEGENERATE
from helixframe.functions.sequence import IUPAC
from helixframe.operators.layout import spread

BLOCK = 4096  #: numbers of an array; further blocks are rows of their own
_MOST = float(1 << 62)


def _letters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def iupac_choices(s: Column, strict: bool = False) -> Column:
    """The bases of each letter; letters outside the code stand for themselves, or for nothing if ``strict``."""
    table = F.create_map(*[x for c, b in IUPAC.items() for x in (F.lit(c), F.array(*[F.lit(y) for y in b]))])
    return F.transform(_letters(s), lambda c: F.coalesce(F.try_element_at(table, c), F.array().cast("array<string>") if strict else F.array(c)))


def codon_choices(protein: Column) -> Column:
    """The degenerate codons of each amino acid; other letters stand for themselves."""
    table = F.create_map(*[x for a, codons in DEGENERATE.items() for x in (F.lit(a), F.array(*[F.lit(c) for c in codons]))])
    return F.transform(_letters(protein), lambda a: F.coalesce(F.try_element_at(table, a), F.array(a)))


def bracket_choices(s: Column) -> tuple[Column, Column]:
    """The distinct brackets of a text, and the letters of each."""
    found = F.array_distinct(F.regexp_extract_all(s, F.lit(r"\[[^\]]+\]"), F.lit(0)))
    return found, F.transform(found, lambda b: F.array_distinct(_letters(F.substring(b, F.lit(2), F.length(b) - 2))))


def variant_rows(df: DataFrame, choices: Column, first_fastest: bool = False) -> DataFrame:
    """``df`` with a row a variant: ``number`` (from 0) and ``variant``, one string of each array joined.

    The last array varies fastest, or the first. A row without arrays has the empty variant, one with an empty
    array, or a null, has none. More than 2**62 variants are refused.
    """
    return _rows(df, choices, first_fastest).withColumn("variant", F.when(F.lit(first_fastest), F.array_join("_picked", "")).otherwise(F.array_join(F.reverse("_picked"), ""))).select(*df.columns, "number", "variant")


def bracket_rows(df: DataFrame, text: str) -> DataFrame:
    """``df`` with a row a variant of A[BC]D: one letter for each distinct bracket, the last varying fastest; null texts have none."""
    found, choices = bracket_choices(F.col(text))
    rows = _rows(df.withColumn("_found", found), choices, False)
    pairs = F.arrays_zip(F.reverse("_found").alias("b"), F.col("_picked").alias("x"))
    return rows.withColumn("variant", F.aggregate(pairs, F.col(text), lambda t, p: F.replace(t, p["b"], p["x"]))).select(*df.columns, "number", "variant")


def _rows(df: DataFrame, choices: Column, first_fastest: bool) -> DataFrame:
    """Adds ``number`` and ``_picked``: the choice of each array, the fastest first."""
    given = df.withColumn("_c", choices).where(F.col("_c").isNotNull())
    ways = F.aggregate("_c", F.lit(1.0), lambda n, c: n * F.size(c))
    given = given.withColumn("_n", F.when(ways > _MOST, F.raise_error(F.lit("more than 2**62 variants"))).otherwise(F.aggregate("_c", F.lit(1).cast("long"), lambda n, c: n * F.size(c)))).where("_n > 0")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    many = spread(given.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("_n") - 1, F.lit(BLOCK).cast("long"))))))
    rows = many.withColumn("number", F.explode(F.transform(upto(F.least(F.lit(BLOCK).cast("long"), F.col("_n") - F.col("_block") * BLOCK)), lambda k: k + F.col("_block") * BLOCK)))
    order = F.col("_c") if first_fastest else F.reverse("_c")
    start = F.struct(F.col("number").alias("left"), F.array().cast("array<string>").alias("picked"))
    whole = lambda a, b: F.call_function("div", a, b.cast("long"))  # noqa: E731 (no floating point: numbers may pass 2**53)
    step = lambda acc, c: F.struct(whole(acc["left"], F.size(c)).alias("left"), F.concat(acc["picked"], F.array(F.get(c, (acc["left"] % F.size(c)).cast("int")))).alias("picked"))
    return rows.withColumn("_picked", F.aggregate(order, start, step, lambda acc: acc["picked"]))
