"""Column functions over nucleotide and protein strings: one place for alphabets, codons and IUPAC codes.

Internal coordinates are 1-based and inclusive. Everything here is native
Spark SQL, so it stays inside code generation and pushes down.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC nucleotide codes, their complements and the standard genetic code.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
COMPLEMENT = ("ATGCRYSWKMBDHVN", "TACGYRSWMKVHDBN")
CODON_BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(CODON_BASES) for j, b in enumerate(CODON_BASES) for k, c in enumerate(CODON_BASES)}
MASK = {code: sum(1 << "ACGT".index(b) for b in bases) for code, bases in IUPAC.items()}


def _map(items: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in items.items() for x in pair])


def reverse_complement(s: Column, alphabet: str = "iupac", others: str = "keep") -> Column:
    """Reverse complement over all IUPAC codes or only ACGT; other letters kept or dropped."""
    source, target = COMPLEMENT if alphabet == "iupac" else ("ATGC", "TACG")
    s = F.regexp_replace(s, "[^ACGT]", "") if others == "drop" else s
    return F.reverse(F.translate(s, source, target))


def gc_percent(s: Column) -> Column:
    return 100.0 * (F.length(s) - F.length(F.translate(s, "GC", ""))) / F.length(s)


def kmers(s: Column, k: Column | int) -> Column:
    """All substrings of length k in order; empty where k is too long."""
    k = F.lit(k) if isinstance(k, int) else k
    n = F.length(s) - k + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(s, i, k))).otherwise(F.array().cast("array<string>"))


def codons(s: Column, frame: int = 1) -> Column:
    """Whole codons of reading frame 1, 2 or 3."""
    n = F.floor((F.length(s) - (frame - 1)) / 3).cast("int")
    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(s, i * 3 + frame, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def translate(s: Column, frame: int = 1, to_stop: bool = False) -> Column:
    """Protein of a frame; unknown codons are skipped, a stop is ``*`` (or ends it)."""
    table = _map(CODONS)
    protein = F.array_join(F.filter(F.transform(codons(s, frame), lambda c: F.try_element_at(table, c)), lambda a: a.isNotNull()), "")
    return F.substring_index(protein, "*", 1) if to_stop else protein


def six_frames(s: Column) -> Column:
    """Array of (frame, protein): F1 to F3, then R1 to R3 of the reverse complement (ACGT only)."""
    back = reverse_complement(s, "acgt")
    return F.array(*[F.struct(F.lit(f"{d}{f}").alias("frame"), translate(x, f).alias("protein")) for d, x in (("F", s), ("R", back)) for f in (1, 2, 3)])


def open_frame(protein: Column) -> Column:
    """No stop, or only as the last codon."""
    return F.instr(protein, "*").isin(0) | (F.instr(protein, "*") == F.length(protein))


def iupac_regex(primer: str) -> str:
    """Character classes for a constant primer; letters outside the code stand for themselves."""
    return "".join(f"[{IUPAC[c]}]" if len(IUPAC.get(c, "")) > 1 else c if c.isalnum() else "\\" + c for c in primer)


def reverse_complement_text(primer: str) -> str:
    return primer.translate(str.maketrans(*COMPLEMENT))[::-1]


_CONTROLS = "".join(map(chr, range(1, 16)))


def masks(s: Column) -> Column:
    """Four-bit base sets of each letter; null for letters outside the code.

    Letters become the characters numbered by their sets, which is faster than a
    map's lookup; such characters in the text itself stand for no base.
    """
    coded = F.translate(s, "".join(MASK) + _CONTROLS, "".join(map(chr, MASK.values())) + "?" * len(_CONTROLS))
    return F.transform(F.split(coded, ""), lambda c: F.when(F.ascii(c).between(1, 15), F.ascii(c)))


def mismatches(a: Column, b: Column) -> Column:
    """Positions of two mask arrays whose base sets don't meet (unknown letters count)."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x.bitwiseAND(y), F.lit(0))), lambda z: z == 0))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once: a lambda evaluates what it refers to at every step."""
    return F.get(F.transform(F.array(value), use), 0)


def hamming_hits(text: Column, pattern: Column, most: Column | int) -> Column:
    """1-based starts where the pattern's masks match the text's with at most ``most`` mismatches."""
    n, m = F.length(text), F.length(pattern)
    starts = F.when(n >= m, F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    bound = F.lit(most) if isinstance(most, int) else most
    both = F.struct(masks(text).alias("t"), masks(pattern).alias("p"))
    return bind(both, lambda v: F.filter(starts, lambda i: mismatches(F.slice(v["t"], i, F.greatest(m, F.lit(1))), v["p"]) <= bound))


def tolerant_hits(text: Column, pattern: str, most: int) -> Column:
    """``hamming_hits`` of a constant pattern by one fold over the text's letters.

    A mismatch counter for each letter of the pattern is kept in the words of a
    bit vector, as many as fit 63 bits. At each letter of the text the counters move
    on by one place and those that it doesn't fit are raised, by one shift and one
    sum a word. A counter's top bit stays set once it has passed ``most``.
    """
    wide = most.bit_length() + 1
    per = 63 // wide
    sets = [MASK.get(c, 0) for c in pattern]
    words = [sets[k : k + per] for k in range(0, len(sets), per)]
    if not words:
        return F.sequence(F.lit(1), F.length(text) + 1)
    full = [(1 << wide * len(w)) - 1 for w in words]
    top = [sum(1 << wide * j + wide - 1 for j in range(len(w))) for w in words]
    raised = [F.array(*[F.lit(sum(1 << wide * j for j, x in enumerate(w) if not x & v)).cast("long") for v in range(16)]) for w in words]
    one, last = (1 << wide) - 1, wide * (len(words[-1]) - 1)

    def step(acc: Column, letter: Column) -> Column:
        fields = [(acc["at"] + 1).alias("at")]
        carry, lost = F.lit(0).cast("long"), F.lit(0).cast("long")
        for k in range(len(words)):
            count, over = acc[f"c{k}"], acc[f"o{k}"]
            moved = F.shiftleft(count, wide).bitwiseAND(F.lit(full[k]).cast("long")) + carry + F.get(raised[k], letter)
            flags = moved.bitwiseAND(F.lit(top[k]).cast("long")).bitwiseOR(F.shiftleft(over, wide).bitwiseAND(F.lit(full[k]).cast("long"))).bitwiseOR(lost)
            fields += [moved.bitwiseAND(F.lit(full[k] & ~top[k]).cast("long")).alias(f"c{k}"), flags.alias(f"o{k}")]
            carry, lost = (F.shiftright(x, wide * (per - 1)).bitwiseAND(F.lit(one).cast("long")) for x in (count, over))

        def noted(v: Column) -> Column:
            k = len(words) - 1
            fits = (F.shiftright(v[f"o{k}"], last).bitwiseAND(F.lit(one).cast("long")) == 0) & (F.shiftright(v[f"c{k}"], last).bitwiseAND(F.lit(one).cast("long")) <= most)
            hits = F.when(fits & (v["at"] >= len(sets)), F.concat(acc["hits"], F.array(v["at"] - (len(sets) - 1)))).otherwise(acc["hits"])
            return F.struct(*[v[name].alias(name) for name in ("at", *[f"{x}{i}" for i in range(len(words)) for x in "co"])], hits.alias("hits"))

        return bind(F.struct(*fields), noted)

    none = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("at"), *[none.alias(f"{x}{k}") for k in range(len(words)) for x in "co"], F.array().cast("array<int>").alias("hits"))
    letters = F.transform(masks(text), lambda m: F.coalesce(m, F.lit(0)))
    return F.aggregate(letters, start, step, lambda acc: acc["hits"])


MOST_VARIANTS = 100_000


def bounded(variants: Column, ways: Column, limit: int | None) -> Column:
    """``variants``; null beyond a given ``limit`` of ways, without one an error beyond ``MOST_VARIANTS``."""
    if limit is not None:
        return F.when(ways <= limit, variants)
    refused = F.raise_error(F.concat(F.lit(f"more than {MOST_VARIANTS} variants: "), ways.cast("string")))
    return F.when(ways > MOST_VARIANTS, refused).otherwise(variants)


def expand(s: Column, first_fastest: bool = False, limit: int | None = None, strict: bool = False) -> Column:
    """All plain variants of an ambiguous sequence; see ``bounded`` for ``limit``.

    Unknown letters stand for themselves, or leave no variant if ``strict``. For more
    variants than fit an array, ``operators.variants.variant_rows`` makes rows.
    """
    table = F.create_map(*[x for c, b in IUPAC.items() for x in (F.lit(c), F.array(*[F.lit(y) for y in b]))])
    choices = F.transform(F.split(s, ""), lambda c: F.coalesce(F.try_element_at(table, c), F.array() if strict else F.array(c)))
    count = F.aggregate(choices, F.lit(1.0), lambda n, c: n * F.size(c))
    seed = F.array(F.lit(""))
    if first_fastest:
        grow = F.aggregate(choices, seed, lambda acc, c: F.flatten(F.transform(c, lambda b: F.transform(acc, lambda v: F.concat(v, b)))))
    else:
        grow = F.aggregate(choices, seed, lambda acc, c: F.flatten(F.transform(acc, lambda v: F.transform(c, lambda b: F.concat(v, b)))))
    return bounded(grow, count, limit)


def max_mismatches(length: Column, similarity: float) -> Column:
    """Length minus the half-even rounded similar part."""
    return (length - F.bround(F.lit(similarity) * length)).cast("int")


# Nearest-neighbour enthalpy (kcal/mol) and entropy (cal/mol K) of DNA and RNA duplexes.
NEAREST_NEIGHBOUR = {
    "AA": (-9.1, -24.0), "AT": (-8.6, -23.9), "TA": (-6.0, -16.9), "CA": (-5.8, -12.9), "GT": (-6.5, -17.3),
    "CT": (-7.8, -20.8), "GA": (-5.6, -13.5), "CG": (-11.9, -27.8), "GC": (-11.1, -26.7), "GG": (-11.0, -26.6),
}
NEAREST_NEIGHBOUR_RNA = {
    "TT": (-6.6, -18.4), "TA": (-5.7, -15.5), "AT": (-8.1, -22.6), "GT": (-10.5, -27.8), "CA": (-10.2, -26.2),
    "GA": (-7.6, -19.2), "CT": (-13.3, -35.5), "GC": (-8.0, -19.4), "CG": (-14.2, -34.9), "CC": (-12.2, -29.7),
}


def melting_temperature(s: Column, sodium_mm: float = 50.0, primer_um: float = 0.5, table: dict[str, tuple[float, float]] | None = None) -> Column:
    """Nearest-neighbour melting temperature in degrees Celsius; pairs outside the table add nothing."""
    table = table or NEAREST_NEIGHBOUR
    pairs = kmers(s, 2)
    total = lambda k: F.aggregate(F.transform(pairs, lambda p: F.coalesce(F.try_element_at(_map({a: v[k] for a, v in table.items()}), p), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return 1000.0 * total(0) / (total(1) - 10.8 + 1.99 * F.log(F.lit(primer_um * 1e-6 / 4))) - 273.15 + 16.6 * F.log10(F.lit(sodium_mm / 1000))


def hairpin(s: Column, stem: int = 4) -> Column:
    """Whether two adjacent stems of equal length (``stem`` or more, under half) are reverse-complementary."""
    n = F.length(s)
    ks = F.when(F.floor((n - 1) / 2) >= stem, F.sequence(F.lit(stem), F.greatest(F.floor((n - 1) / 2).cast("int"), F.lit(stem)))).otherwise(F.array().cast("array<int>"))
    fits = lambda k: F.exists(F.sequence(F.lit(1), F.greatest(n - 2 * k + 1, F.lit(1))), lambda i: F.substring(s, i, k) == reverse_complement(F.substring(s, i + k, k), "acgt"))
    return F.exists(ks, fits)


def wrap(s: Column, width: int = 80) -> Column:
    return F.regexp_replace(s, f"(.{{{width}}})(?=.)", "$1\n")


def truncated(s: Column, width: int) -> Column:
    return F.when(F.length(s) > width, F.concat(F.left(s, F.lit(width - 3)), F.lit("..."))).otherwise(s)


def base_frequencies(s: Column) -> Column:
    """Struct of the shares of A, T, G and C among all letters; null for an empty text."""
    return F.struct(*[F.try_divide((F.length(s) - F.length(F.replace(s, F.lit(b), F.lit("")))).cast("double"), F.length(s)).alias(b.lower()) for b in "ATGC"])


def numbered_id(key: Column, number: Column, width: int = 0) -> Column:
    """``key_number``, the number padded with zeros to ``width`` digits."""
    text = number.cast("string")
    return F.concat(key.cast("string"), F.lit("_"), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text) if width else text)


def percent_text(share: Column) -> Column:
    """A share as percent with two digits."""
    return F.format_string("%.2f", 100.0 * share)


def has_keyword(text: Column, keywords: list[str]) -> Column:
    """Whether any of the patterns is found; null for a null text."""
    out = F.lit(False)
    for k in keywords:
        out = out | text.rlike(k)
    return F.when(text.isNotNull(), out)
