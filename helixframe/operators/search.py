"""Mapping with thresholds on both strands, windows by k-mers, flanking primers, overlap filters and set-cover dedup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.coding import circular_end, occurs_once, window_similarities
from helixframe.functions.sequence import hairpin, max_mismatches, melting_temperature, reverse_complement
from helixframe.operators.frames import STARTS, cut_out, frames
from helixframe.operators.layout import meet, spread
from helixframe.operators.pieces import PIECE, pieces, record_key
from helixframe.operators.seeds import fitting, rows_of


def _windows(long: Column, size: Column) -> Column:
    """1-based window starts."""
    last = F.length(long) - size + 1
    return F.when((size > 0) & (last >= 1), F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def _sides(shorts: DataFrame, longs: DataFrame, most: Callable[[Column], Column], strands: bool) -> tuple[DataFrame, DataFrame]:
    """What ``seeds.fitting`` takes, with id and times of the rows of both sides."""
    text = F.col("sequence")
    forms = [(F.lit("+"), text), (F.lit("-"), reverse_complement(text))] if strands else [(F.lit("."), text)]
    short = rows_of(shorts, "s_key").select("s_key", F.col("id").alias("s_id"), F.col("times").alias("s_times"), F.explode(F.array(*[F.struct(f.alias("form"), s.alias("s")) for f, s in forms])).alias("f"))
    short = short.select("s_key", "s_id", "s_times", "f.form", "f.s", most(F.length("f.s")).alias("most"))
    return short, rows_of(longs, "l_key").select("l_key", F.col("id").alias("l_id"), F.col("times").alias("l_times"), text.alias("l"))


def _repeated(rows: DataFrame) -> DataFrame:
    """Each row for every copy of its two texts."""
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("s_times") * F.col("l_times")))).drop("_copy")


def map_pairs(queries: DataFrame, references: DataFrame, similarity: float = 0.85, coverage: float = 0.0, nucleotide: bool = True, circular: bool = False) -> DataFrame:
    """(short_id, long_id, start, end, mismatch, similarity, coverage, strand), ambiguity codes on either side.

    The shorter text of a pair is searched in the longer one (the query in the
    reference if they tie), for pairs within the coverage. Texts meet through
    seeds, see ``seeds``, and are compared at the places that these name.
    Reverse-strand places count where the forward strand has none in the pair, and where they are
    strictly better than every forward place. Null and empty texts match nothing; rows that repeat keep their number.
    """
    if circular and not nucleotide:
        raise ValueError("only nucleotide references are circular")
    covered = F.col("n") / F.col("m") >= coverage

    def one_way(a: DataFrame, b: DataFrame, shorter: bool) -> DataFrame:
        found = fitting(*_sides(a, b, lambda n: max_mismatches(n, similarity), nucleotide), covered & (F.col("n") <= F.col("m")), nucleotide, circular, shorter=shorter)
        if nucleotide:
            best = F.min(F.when(F.col("form") == "+", F.col("mismatch"))).over(Window.partitionBy("s_key", "l_key"))
            found = found.withColumn("best", best).where("form = '+' OR best IS NULL OR mismatch < best")
        return _repeated(found)

    rows = one_way(queries, references, False).unionByName(one_way(references, queries, True))
    end = F.col("start") + F.col("n") - 1
    return rows.select(
        F.col("s_id").alias("short_id"), F.col("l_id").alias("long_id"), "start", (circular_end(end, F.col("m")) if circular else end).alias("end"), "mismatch",
        ((F.col("n") - F.col("mismatch")) / F.col("n")).alias("similarity"), (F.col("n") / F.col("m")).alias("coverage"), F.col("form").alias("strand"),
    )


def map_windows(df: DataFrame, long: str, short: str, similarity: float = 0.0, coverage: float = 0.0, k: int = 3) -> DataFrame:
    """Adds start, end and similarity of each window of the longer string whose k-mers match over the threshold (k at least a fifth of the shorter)."""
    a, b = F.col(long), F.col(short)
    big, small = (F.when(F.length(a) >= F.length(b), x).otherwise(y) for x, y in ((a, b), (b, a)))
    rows = spread(df).withColumns({"_l": big, "_s": small}).where(F.length("_s") / F.length("_l") > coverage)
    size = F.greatest(F.floor(F.length("_s") / 5).cast("int"), F.lit(k))
    scored = window_similarities(F.col("_s"), F.col("_l"), size, _windows(F.col("_l"), F.length("_s")))
    rows = rows.select("*", F.inline(F.filter(scored, lambda w: w["similarity"] > similarity)))
    return rows.select(*df.columns, "start", (F.col("start") + F.length("_s") - 1).alias("end"), "similarity")


def mutual_windows(queries: DataFrame, references: DataFrame) -> DataFrame:
    """(query_id, ref_id, start, end) where query and window match by ``mutual_match``; texts meet through seeds, see ``seeds``."""
    rows = _repeated(fitting(*_sides(queries, references, lambda n: F.lit(0), False), F.col("n") <= F.col("m"), mutual=True))
    return rows.select(F.col("s_id").alias("query_id"), F.col("l_id").alias("ref_id"), "start", (F.col("start") + F.col("n") - 1).alias("end"))


def flanking_primers(df: DataFrame, target_start: int, target_end: int, size: int = 20, low: float = 50.0, high: float = 60.0) -> DataFrame:
    """(id, primer, position, start, end, tm) of windows wholly beside the target (1-based, inclusive) that melt in range, form no hairpin and occur once."""
    s, n = F.col("sequence"), F.lit(size)
    last = F.length(s) - size + 1
    rows = spread(df).where(last >= 1).select("id", s, F.explode(F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).alias("start"))
    where = F.when(F.col("start") + size - 1 < target_start, "upstream").when(F.col("start") > target_end, "downstream")
    rows = rows.withColumn("position", where).where("position IS NOT NULL").withColumn("primer", F.substring(s, F.col("start"), n))
    rows = rows.withColumn("tm", melting_temperature(F.col("primer"))).where(F.col("tm").between(low, high))
    kept = rows.where(~hairpin(F.col("primer"))).where(occurs_once(s, F.col("primer")))
    return kept.select("id", "primer", "position", "start", (F.col("start") + size - 1).alias("end"), "tm")


def overlaps(spans: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of different overlapping intervals: ``by``, start, end, and the other one's s and e, each pair both ways.

    ``spans``: ``by``, start, end (inclusive), distinct. An interval belongs to the class of lengths up to a power of
    two and to one block as long as that, and looks for others in the classes of its own length or longer, in three
    blocks each: what overlaps it there starts in them. So one long interval costs each other one three rows.
    """
    level = F.ceil(F.log2(F.greatest(F.col("end") - F.col("start") + 1, F.lit(1)).cast("double"))).cast("int")
    spans = spans.withColumn("_c", level)
    wide = sorted(r[0] for r in spans.select("_c").distinct().collect())  # 64 at most
    held = spans.select(*by, F.col("start").alias("s"), F.col("end").alias("e"), "_c", F.floor(F.col("start") / F.pow(F.lit(2.0), F.col("_c"))).alias("_b"))
    classes = F.filter(F.array(*[F.lit(c) for c in wide or [0]]), lambda c: c >= F.col("_c"))
    asked = spans.select(*by, "start", "end", F.explode(classes).alias("_c"))
    own = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_c")))
    asked = asked.withColumn("_b", F.explode(F.sequence(own("start") - 1, own("end"))))
    pairs = meet(asked, held, [*by, "_c", "_b"]).where("start <= e AND end >= s AND NOT (start = s AND end = e)").select(*by, "start", "end", "s", "e")
    return pairs.union(pairs.select(*by, F.col("s"), F.col("e"), F.col("start"), F.col("end"))).distinct()


def keep_longer_overlaps(orfs: DataFrame, key: str = "id") -> DataFrame:
    """Of each interval and the first other one on its strand that overlaps it, the longer (ties: the other); intervals alone stay.

    ``orfs``: key, strand, start, end (inclusive). "First" is by start, then end.
    """
    by = [key, "strand"]
    spans = orfs.select(*by, "start", "end").distinct()
    other = overlaps(spans, by).groupBy(*by, "start", "end").agg(F.min(F.struct("s", "e")).alias("o"))
    first = meet(spans, other, [*by, "start", "end"], "left")
    own = F.col("o").isNull() | (F.col("end") - F.col("start") > F.col("o.e") - F.col("o.s"))
    pick = F.when(own, F.struct("start", "end")).otherwise(F.struct(F.col("o.s").alias("start"), F.col("o.e").alias("end")))
    return first.select(*by, pick.alias("p")).select(*by, "p.start", "p.end").distinct()


def find_orfs(df: DataFrame, starts: tuple[str, ...] = STARTS, longer_only: bool = True) -> DataFrame:
    """(id, strand, start, end, n, sequence) of open reading frames on both strands, in forward coordinates (1-based, inclusive).

    Frames run from a start codon to the first stop in frame. Those of the reverse strand are mirrored: they end
    where they start there. With ``longer_only`` each frame and the first that overlaps it on its strand give the longer.
    Records are told by row: repeated rows have their frames each, and ids may be null.
    """
    back = F.col("strand") == "-"
    mirror = lambda c: F.col("n") - F.col(c) + 1
    found = frames(df, starts).select("_key", "strand", F.when(back, mirror("end")).otherwise(F.col("start")).alias("start"), F.when(back, mirror("start")).otherwise(F.col("end")).alias("end"))
    kept = keep_longer_overlaps(found, "_key") if longer_only else found.distinct()
    records = df.groupBy(record_key("id", "sequence").alias("_key")).agg(F.first("id").alias("id"), F.count("*").alias("times"))
    cut = meet(cut_out(df, kept), records, "_key").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return cut.select("id", "strand", "start", "end", (F.col("end") - F.col("start") + 1).alias("n"), "sequence")


def cover_dedup(df: DataFrame, group: str, id_col: str = "id", sequence: str = "sequence") -> DataFrame:
    """Per group, longest first (ties by id): drop a sequence whose k-mers (k: the group's shortest length) were all seen.

    What was seen is what all earlier sequences hold, as those dropped add nothing.
    So a sequence stays if it is the first holder of one of its k-mers: one
    aggregate by group and k-mer, and no group or record is one task's work. Nulls count as
    empty; in a group whose shortest is empty only the first stays. Of copies one stays.
    """
    key = record_key(group, id_col, sequence)
    rows = spread(df).select(F.col(group).alias("_g"), F.col(id_col).alias("_id"), F.coalesce(sequence, F.lit("")).alias("sequence"), key.alias("_key"))
    least = rows.groupBy("_g").agg(F.min(F.length("sequence")).alias("k"))
    widest = max(least.agg(F.max("k")).first()[0] or 1, 1)
    told = rows.join(least.withColumnRenamed("_g", "_own"), F.col("_g").eqNullSafe(F.col("_own"))).select("_g", "k", F.struct((-F.length("sequence")).alias("n"), F.col("_id").isNull().alias("null"), "_id", "_key").alias("rank"), "sequence")
    size = max(PIECE, 2 * widest)
    held = pieces(told.where("k > 0"), widest - 1, size)
    last = F.least(F.length("piece") - F.col("k") + 1, F.lit(size))
    grams = held.where(last >= 1).withColumn("at", F.explode(F.sequence(F.lit(1), last))).select("_g", F.substring("piece", F.col("at"), F.col("k")).alias("kmer"), "rank")
    first = grams.groupBy("_g", "kmer").agg(F.min("rank").alias("rank")).union(told.where("k = 0").groupBy("_g").agg(F.lit("").alias("kmer"), F.min("rank").alias("rank")))
    kept = meet(df.withColumn("_key", key), first.select(F.col("rank._key").alias("_kept")).distinct(), F.col("_key") == F.col("_kept"), "left_semi")
    turn = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0)))
    return kept.withColumn("_turn", turn).where("_turn = 1").select(*df.columns)


def sample_layout(files: DataFrame, matches: str = "n_matches", reads: str = "n_reads") -> DataFrame:
    """Per sample: files, matches, reads, and whether it is single or paired end with equal read counts.

    ``files``: sample, file and the two counts, one row a file.
    """
    agg = files.groupBy("sample").agg(F.count_distinct("file").alias("n_files"), F.sum(matches).alias(matches), F.sum(reads).alias(reads), (F.min(reads) == F.max(reads)).alias("equal"))
    return agg.withColumn("layout", F.when(F.col("n_files") == 1, "SE").when((F.col("n_files") == 2) & F.col("equal"), "PE").otherwise("UNEQUAL")).drop("equal")
