"""Primer matching, mapping with mismatches, intervals, open reading frames."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import iupac_regex, reverse_complement, reverse_complement_text, tolerant_hits
from helixframe.operators.frames import STARTS, frames
from helixframe.operators.layout import meet, spread
from helixframe.operators.pieces import PIECE, pieces, record_key
from helixframe.operators.seeds import fitting


def primer_pair(s: Column, forward: str, reverse: str) -> Column:
    """Forward variant and reverse complement of a reverse variant both found."""
    return s.rlike(iupac_regex(forward)) & s.rlike(iupac_regex(reverse_complement_text(reverse)))


def anchored(s: Column, primer: str) -> Column:
    """FORWARD if the leftmost match starts the sequence, REVERSE if it ends it, else NONE."""
    at = F.regexp_instr(s, F.lit(iupac_regex(primer)))
    return F.when(at == 1, "FORWARD").when((at > 0) & (at + len(primer) - 1 == F.length(s)), "REVERSE").otherwise("NONE")


def amplicons(df: DataFrame, forward: str, reverse: str) -> DataFrame:
    """Shortest stretch between the first forward primer and the following reverse primer; quality is cut alike."""
    f, r = iupac_regex(forward), iupac_regex(reverse_complement_text(reverse))
    start = F.regexp_instr("sequence", F.lit(f)) + len(forward)
    inner = F.regexp_extract("sequence", f"{f}(.*?){r}", 1)
    cut = df.where(F.col("sequence").rlike(f"{f}.*?{r}"))
    out = cut.select(F.concat("id", F.lit(f"_{forward}_{reverse}")).alias("id"), inner.alias("sequence"), *([F.substring("quality", start, F.length(inner)).alias("quality")] if "quality" in df.columns else []))
    return out


#: Letters, and texts within its mismatches, of a query that is told by all of these.
WHOLE, TEXTS = 16, 1024
#: Letters of a seed; shorter pieces take the nested loop, longer ones are cut.
SEEDS = (4, 8, 16, 32)


def seed_size(piece: Column) -> Column:
    """The largest seed that a piece holds; null where it holds none."""
    out = F.lit(None).cast("int")
    for size in SEEDS:
        out = F.when(piece >= size, size).otherwise(out)
    return out


def texts_within(n: int, most: int) -> int:
    """Plain texts of ``n`` letters within ``most`` mismatches of one."""
    return sum(comb(n, k) * 3**k for k in range(most + 1))


def _whole(q: DataFrame, r: DataFrame, most: int) -> DataFrame:
    """Places of short plain queries: each text within ``most`` mismatches of a query meets the stretches that are this text, so nothing else meets."""
    lengths = sorted(x[0] for x in q.select(F.length("q")).distinct().collect())  # no more than WHOLE
    at = rows = q.select("query_id", "strand", F.length("q").alias("n"), F.col("q").alias("text"), F.lit(0).alias("last"), F.lit(0).alias("mismatch"))
    for k in range(1, most + 1):  # one more letter differs, behind the last one that does
        at = at.where("last < n").withColumn("last", F.explode(F.sequence(F.col("last") + 1, F.col("n")))).withColumn("c", F.explode(F.array(*map(F.lit, "ACGT"))))
        at = at.where(F.col("c") != F.substring("text", F.col("last"), F.lit(1))).select("query_id", "strand", "n", F.overlay("text", "c", "last").alias("text"), "last", F.lit(k).alias("mismatch"))
        rows = rows.union(at)
    n = F.explode(F.array(*map(F.lit, lengths or [1])))
    held = r.select("ref_id", "r", n.alias("n")).where("n <= length(r)").withColumn("start", F.explode(F.sequence(F.lit(1), F.length("r") - F.col("n") + 1)))
    found = meet(rows.drop("n", "last"), held.select("ref_id", "start", F.substring("r", F.col("start"), F.col("n")).alias("text")), "text")
    return found.select("query_id", "ref_id", "strand", "start", (F.col("start") + F.length("text") - 1).alias("end"), "mismatch")


def map_queries(queries: DataFrame, references: DataFrame, most: int, strands: bool = True) -> DataFrame:
    """(query_id, ref_id, strand, start, end, mismatch) of queries within ``most`` mismatches; codes match where their base sets meet.

    Short plain queries (up to ``WHOLE`` letters, with up to ``TEXTS`` texts within their mismatches) join on these texts.
    Of most + 1 pieces of a longer plain query one matches a plain reference exactly, and of most + 2 pieces two do. Queries
    whose pieces hold eight letters or more join on one piece; shorter ones join on two, with the distance between
    them, so that a seed is twice as long. A window carries the letters around a seed, no more than twice the longest seeded query, never its
    whole reference. A place counts by the first of its pieces that match, so none is found twice and rows that
    repeat keep their number. Ambiguous texts, and queries with pieces of one letter, meet through the seeds of ``seeds``.
    """
    key = record_key("id", "sequence")
    q = queries.select(F.col("id").alias("query_id"), F.upper("sequence").alias("q"), F.lit("+").alias("strand"), key.alias("s_key"))
    if strands:
        q = q.union(queries.select("id", reverse_complement(F.upper("sequence")), F.lit("-"), key))
    plain = lambda c: F.coalesce(~F.col(c).rlike("[^ACGT]"), F.lit(False))
    n = F.length("q")
    one, two = F.floor(n / (most + 1)).cast("int"), F.floor(n / (most + 2)).cast("int")
    whole = max((k for k in range(1, WHOLE + 1) if texts_within(k, most) <= TEXTS), default=0)
    q = q.where("length(q) > 0").withColumn("pieces", F.when(plain("q") & (one >= 8), 1).when(plain("q") & (n <= whole), 0).when(plain("q") & (two >= 2), 2))
    q = q.withColumn("step", F.when(F.col("pieces") == 1, one).when(F.col("pieces") == 2, two)).withColumn("size", F.when(F.col("pieces") == 1, seed_size(one)).otherwise(F.col("step")))
    r = spread(references.select(F.col("id").alias("ref_id"), F.upper("sequence").alias("r"), key.alias("l_key")))

    held = q.where("pieces > 0").groupBy("pieces", "size").agg(F.max(n).alias("n")).collect()  # three sizes of one piece, six of two
    reach = max((x["n"] for x in held), default=1)
    kinds = sorted({(x["size"], d * x["size"]) for x in held for d in ((0,) if x["pieces"] == 1 else range(1, most + 2))}) or [(1, 0)]
    pairs = lambda found: F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in found])
    chosen = F.when(F.col("pieces") == 1, pairs([(i, i) for i in range(most + 1)])).otherwise(pairs([(i, j) for j in range(most + 2) for i in range(j)]))
    piece = lambda k, text="q": F.substring(text, k * F.col("step") + 1, F.col("size"))
    seeds = q.where("pieces > 0").withColumn("p", F.explode(chosen)).select("query_id", "q", "strand", "step", "size", F.col("p.i").alias("i"), F.col("p.j").alias("j"))
    seeds = seeds.withColumn("apart", (F.col("j") - F.col("i")) * F.col("step")).withColumn("seed", F.when(F.col("i") == F.col("j"), piece(F.col("i"))).otherwise(F.concat(piece(F.col("i")), piece(F.col("j")))))
    places = r.where(plain("r")).select("ref_id", "r", F.explode(F.array(*[F.struct(F.lit(k).alias("size"), F.lit(d).alias("apart")) for k, d in kinds])).alias("k")).select("ref_id", "r", "k.size", "k.apart")
    places = places.withColumn("last", F.length("r") - F.col("size") - F.col("apart") + 1).where("last >= 1").withColumn("pos", F.explode(F.sequence(F.lit(1), F.col("last"))))
    from_ = F.greatest(F.col("pos") - reach, F.lit(1))
    at = lambda p: F.substring("r", p, F.col("size"))
    seed = F.when(F.col("apart") == 0, at(F.col("pos"))).otherwise(F.concat(at(F.col("pos")), at(F.col("pos") + F.col("apart"))))
    places = places.select("ref_id", "size", "apart", "pos", from_.alias("from"), seed.alias("seed"), F.substring("r", from_, F.col("pos") - from_ + reach).alias("near"))
    start = F.col("start")
    hit = F.substring("near", start - F.col("from") + 1, n)
    found = meet(seeds, places, ["size", "apart", "seed"]).withColumn("start", F.col("pos") - F.col("i") * F.col("step")).where("start >= 1")
    found = found.withColumn("hit", hit).where("length(hit) = length(q)")
    for k in range(most + 1):  # a place counts once: by the first of its pieces that match
        found = found.where((F.col("j") <= k) | (F.col("i") == k) | (piece(F.lit(k)) != piece(F.lit(k), "hit")))
    letters = lambda c: F.split(c, "")
    differ = F.size(F.filter(F.zip_with(letters("q"), letters("hit"), lambda x, y: x != y), lambda z: z))
    found = found.withColumn("mismatch", differ).where(F.col("mismatch") <= most)
    found = found.select("query_id", "ref_id", "strand", "start", (start + n - 1).alias("end"), "mismatch")
    short = _whole(q.where("pieces = 0"), r.where(plain("r")), most)
    found = short.unionByName(found) if held else short

    def coded(some: DataFrame, texts: DataFrame) -> DataFrame:
        short = some.groupBy("s_key", F.col("strand").alias("form")).agg(F.first("query_id").alias("query_id"), F.first("q").alias("s"), F.count("*").alias("s_times")).withColumn("most", F.lit(most))
        long = texts.groupBy("l_key").agg(F.first("ref_id").alias("ref_id"), F.first("r").alias("l"), F.count("*").alias("l_times"))
        rows = fitting(short, long, F.col("n") <= F.col("m")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("s_times") * F.col("l_times"))))
        return rows.select("query_id", "ref_id", F.col("form").alias("strand"), "start", (F.col("start") + F.col("n") - 1).alias("end"), "mismatch")

    return found.unionByName(coded(q.where("pieces IS NULL"), r)).unionByName(coded(q.where("pieces IS NOT NULL"), r.where(~plain("r"))))


def map_one(text: DataFrame, pattern: str, most: int) -> DataFrame:
    """(id, start) of every place where an IUPAC pattern fits within ``most`` mismatches; long texts are folded piece by piece."""
    size = max(PIECE, 2 * len(pattern))
    held = pieces(spread(text.select("id", "sequence")), max(len(pattern) - 1, 0), size)
    hits = held.select("id", "number", F.explode(tolerant_hits(F.col("piece"), pattern, most)).alias("at"))
    return hits.select("id", (F.col("number") * size + F.col("at")).alias("start"))


def extract_intervals(seqs: DataFrame, intervals: DataFrame) -> DataFrame:
    """Interval sequences, 1-based inclusive; start > end is the reverse complement of the swapped interval. What lies before the first letter or behind the last is left out."""
    low, high = F.greatest(F.least("start", "end"), F.lit(1)), F.greatest("start", "end")
    piece = F.substring("sequence", low, F.greatest(high - low + 1, F.lit(0)))
    joined = seqs.join(intervals, "id")
    return joined.select("id", "start", "end", "annotation", F.when(F.col("start") > F.col("end"), reverse_complement(piece)).otherwise(piece).alias("sequence"))


def introns(exons: DataFrame, transcript: str = "transcript") -> DataFrame:
    """Gaps between following exons, in coordinate order."""
    following = F.lead("start").over(Window.partitionBy(transcript).orderBy("start", "end"))
    return exons.select(transcript, (F.col("end") + 1).alias("start"), (following - 1).alias("end")).where("end IS NOT NULL")


def open_reading_frames(df: DataFrame, starts: tuple[str, ...] = STARTS) -> DataFrame:
    """(id, strand, start, end) from each start codon to the first stop in its frame, 1-based on the given strand."""
    return frames(df, starts).select("id", "strand", "start", "end")
