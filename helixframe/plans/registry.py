"""Registered queries over the driver's tables, each with the SQL that must give the same rows.

The tables hold no sequences, so nucleotide strings are derived from keys by a
digest: 32 letters each, or a length that follows from the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import coding as C
from helixframe.functions import sequence as S
from helixframe.operators import dedup, kmers, mapping, search, stats, tables
from helixframe.operators.layout import spread
from helixframe.sources import fasta, flatfiles, responses
from helixframe.sources import tables as source_tables

Query = Callable[[SparkSession, str], DataFrame]
HEX, PLAIN, CODED = "0123456789abcdef", "ACGTACGTACGTACGT", "ACGTRYSWKMBDHVNA"
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dna(spark: SparkSession, sf_dir: str, table: str = "part", key: str = "p_partkey", letters: str = PLAIN, mixed: bool = False) -> DataFrame:
    digest = F.md5(F.col(key).cast("string"))
    cut = F.substring(digest, F.lit(1), (F.col(key) % 9 + 4).cast("int")) if mixed else digest
    return _table(spark, sf_dir, table).select(F.col(key).alias("id"), F.translate(cut, HEX, letters).alias("sequence"))


def _dna_sql(table: str = "part", key: str = "p_partkey", letters: str = PLAIN, mixed: bool = False) -> str:
    digest = f"md5({key}::VARCHAR)"
    digest = f"substr({digest}, 1, ({key} % 9 + 4)::INT)" if mixed else digest
    return f"SELECT {key} AS id, translate({digest}, '{HEX}', '{letters}') AS sequence FROM {table}"


_RC = "reverse(translate({}, 'ATGC', 'TACG'))"
_RC_ALL = f"reverse(translate({{}}, '{S.COMPLEMENT[0]}', '{S.COMPLEMENT[1]}'))"
_CODON_MAP = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in S.CODONS.items()) + "}"
_KMERS = "list_transform(range(1, length({s}) - {k} + 2), lambda i: substr({s}, i, {k}))"


@_register("""
WITH d AS (SELECT source, length(text)::BIGINT AS l FROM documents),
w AS (SELECT source, l, sum(l) OVER (PARTITION BY source ORDER BY l ROWS UNBOUNDED PRECEDING) AS cum, sum(l) OVER (PARTITION BY source) AS tot FROM d)
SELECT source, count(*) AS n_seqs, sum(l)::BIGINT AS total_len, min(l) AS min_len, max(l) AS max_len, sum(l::DOUBLE * l) / sum(l) AS aun,
    min(l) FILTER (WHERE 100 * cum >= tot * 50) AS n50, min(l) FILTER (WHERE 100 * cum >= tot * 10) AS n90 FROM w GROUP BY source""")
def asm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.length_stats(_table(spark, sf_dir, "documents").select("source", F.length("text").alias("length")), "source")


@_register(f"""SELECT p_brand, avg(100.0 * (length(s) - length(replace(replace(s, 'G', ''), 'C', ''))) / length(s)) AS gc_percent
FROM (SELECT p_brand, translate(md5(p_partkey::VARCHAR), '{HEX}', '{PLAIN}') AS s FROM part) GROUP BY 1""")
def gc_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = _table(spark, sf_dir, "part").select("p_brand", F.translate(F.md5(F.col("p_partkey").cast("string")), HEX, PLAIN).alias("sequence"))
    return stats.mean_gc(seqs, "p_brand")


@_register(f"SELECT id, {_RC.format('sequence')} AS revcomp, {_RC.format(chr(39) * 2)} || {_RC_ALL.format('sequence')} AS revcomp_iupac FROM ({_dna_sql(letters=CODED)})")
def reverse_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sequence")
    return _dna(spark, sf_dir, letters=CODED).select("id", S.reverse_complement(s, "acgt").alias("revcomp"), S.reverse_complement(s).alias("revcomp_iupac"))


@_register(f"SELECT id, {_RC.format("regexp_replace(sequence, '[^ACGT]', '', 'g')")} AS revcomp FROM ({_dna_sql(letters=CODED)})")
def reverse_complement_plain_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dna(spark, sf_dir, letters=CODED).select("id", S.reverse_complement(F.col("sequence"), "acgt", "drop").alias("revcomp"))


@_register(f"""SELECT kmer, count(*) AS n, count(DISTINCT id) AS n_ids FROM (SELECT id, unnest({_KMERS.format(s='sequence', k=6)}) AS kmer FROM ({_dna_sql()})) GROUP BY 1""")
def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.kmer_counts(_dna(spark, sf_dir), 6)


@_register(f"""WITH d AS ({_dna_sql()}), k AS (SELECT id, unnest({_KMERS.format(s='sequence', k=11)}) AS kmer FROM d)
SELECT id, sequence FROM d WHERE id IN (SELECT id FROM k WHERE kmer IN (SELECT kmer FROM k GROUP BY 1 HAVING count(DISTINCT id) > 1))""")
def sharing_kmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.sharing_kmer(_dna(spark, sf_dir), 11)


@_register(f"""WITH d AS ({_dna_sql()}), k AS (SELECT id, unnest({_KMERS.format(s='sequence', k=10)}) AS kmer FROM d)
SELECT id, sequence FROM d WHERE id IN (SELECT id FROM k WHERE kmer IN (SELECT kmer FROM k GROUP BY 1 HAVING count(*) > 1))""")
def repeated_kmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.repeated_kmer(_dna(spark, sf_dir), 10)


@_register("SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def first_per_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_per_sequence(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@_register(f"WITH d AS ({_dna_sql(mixed=True)}) SELECT id, sequence FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE length(b.sequence) > length(a.sequence) AND contains(b.sequence, a.sequence))")
def not_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.drop_contained(_dna(spark, sf_dir, mixed=True))


@_register("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(_table(spark, sf_dir, "customer"), "c_mktsegment")


@_register(f"SELECT codon, count(*) AS n, count(*) / 64.0::DOUBLE AS bias FROM (SELECT unnest(list_transform(range(0, length(sequence) // 3), lambda i: substr(sequence, i * 3 + 1, 3))) AS codon FROM ({_dna_sql()})) GROUP BY 1")
def codon_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.codon_bias(_dna(spark, sf_dir))


_FRAMES = " UNION ALL ".join(f"SELECT id, '{d}{f}' AS frame, substr({s}, {f}) AS s FROM d" for d, s in (("F", "sequence"), ("R", _RC.format("sequence"))) for f in (1, 2, 3))
_PROTEINS = f"""WITH d AS ({{}}), f AS ({_FRAMES}), p AS (SELECT id, frame,
array_to_string(list_filter(list_transform(range(0, length(s) // 3), lambda i: ({_CODON_MAP})[substr(s, i * 3 + 1, 3)]), lambda a: a IS NOT NULL), '') AS protein FROM f)"""


@_register(_PROTEINS.replace("{}", _dna_sql(letters=CODED)) + " SELECT id, frame, protein FROM p")
def six_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_dna(spark, sf_dir, letters=CODED)).select("id", F.inline(S.six_frames(F.col("sequence"))))


@_register(_PROTEINS.replace("{}", _dna_sql()) + " SELECT id, frame, protein FROM p WHERE instr(protein, '*') IN (0, length(protein))")
def open_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_dna(spark, sf_dir)).select("id", F.inline(S.six_frames(F.col("sequence")))).where(S.open_frame(F.col("protein")))


@_register(_PROTEINS.replace("{}", _dna_sql()) + " SELECT id, string_split(protein, '*')[1] AS protein FROM p WHERE frame = 'F1'")
def first_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dna(spark, sf_dir).select("id", S.translate(F.col("sequence"), 1, to_stop=True).alias("protein"))


FORWARD, REVERSE = "ARN", "CYT"
_F, _R = S.iupac_regex(FORWARD), S.iupac_regex(S.reverse_complement_text(REVERSE))


@_register(f"SELECT id, regexp_matches(sequence, '{_F}') AND regexp_matches(sequence, '{_R}') AS present FROM ({_dna_sql()})")
def primer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dna(spark, sf_dir).select("id", mapping.primer_pair(F.col("sequence"), FORWARD, REVERSE).alias("present"))


@_register(f"""SELECT id, CASE WHEN pos = 1 THEN 'FORWARD' WHEN pos > 0 AND pos + 2 = length(sequence) THEN 'REVERSE' ELSE 'NONE' END AS side
FROM (SELECT id, sequence, CASE WHEN m <> '' THEN instr(sequence, m) ELSE 0 END AS pos FROM (SELECT *, regexp_extract(sequence, '{_F}') AS m FROM ({_dna_sql()})))""")
def anchored_primers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dna(spark, sf_dir).select("id", mapping.anchored(F.col("sequence"), FORWARD).alias("side"))


@_register(f"SELECT id || '_{FORWARD}_{REVERSE}' AS id, regexp_extract(sequence, '{_F}(.*?){_R}', 1) AS sequence FROM ({_dna_sql()}) WHERE regexp_matches(sequence, '{_F}.*?{_R}')")
def amplicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.amplicons(_dna(spark, sf_dir).withColumn("id", F.col("id").cast("string")), FORWARD, REVERSE)


_IUPAC_ROWS = ", ".join(f"('{c}', '{b}')" for c, bases in S.IUPAC.items() for b in bases)


@_register(f"""WITH RECURSIVE m(c, b) AS (VALUES {_IUPAC_ROWS}), d AS (SELECT s_suppkey AS id, translate(substr(md5(s_suppkey::VARCHAR), 1, 5), '{HEX}', '{CODED}') AS sequence FROM supplier),
r AS (SELECT id, sequence, 0 AS k, '' AS variant FROM d UNION ALL SELECT id, sequence, k + 1, variant || b FROM r JOIN m ON c = substr(sequence, k + 1, 1) WHERE k < 5)
SELECT id, variant FROM r WHERE k = 5""")
def iupac_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    coded = F.translate(F.substring(F.md5(key.cast("string")), 1, 5), HEX, CODED)
    return _table(spark, sf_dir, "supplier").select(key.alias("id"), F.explode(S.expand(coded)).alias("variant"))


@_register(f"""SELECT id, i AS start FROM ({_dna_sql()}), range(1, 29) x(i)
WHERE len(list_filter(range(0, 5), lambda k: NOT contains(['A', 'AG', 'ACGT', 'CT', 'G'][k + 1], substr(sequence, (i + k)::INT, 1)))) <= 1""")
def pattern_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.map_one(_dna(spark, sf_dir), "ARNYG", 1).select("id", F.col("start").cast("long").alias("start"))


_Q12 = f"SELECT s_suppkey AS id, translate(substr(md5(s_suppkey::VARCHAR), 1, 12), '{HEX}', '{PLAIN}') AS q FROM supplier"


@_register(f"""WITH q AS (SELECT id, q, '+' AS strand FROM ({_Q12}) UNION ALL SELECT id, {_RC.format('q')}, '-' FROM ({_Q12})), r AS ({_dna_sql()}),
m AS (SELECT q.id AS query_id, r.id AS ref_id, strand, i AS start, i + 11 AS "end", hamming(q, substr(sequence, i::INT, 12)) AS mismatch FROM q, r, range(1, 22) x(i))
SELECT query_id, ref_id, strand, start, "end", mismatch FROM m WHERE mismatch <= 2""")
def mapped_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.translate(F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 12), HEX, PLAIN).alias("sequence"))
    out = mapping.map_queries(queries, _dna(spark, sf_dir), 2)
    return out.withColumns({c: F.col(c).cast("long") for c in ("start", "end", "mismatch")})


_NN = "MAP {" + ", ".join(f"'{p}': {{}}".format(v) for p, v in ((p, f"[{h}, {s}]") for p, (h, s) in S.NEAREST_NEIGHBOUR.items())) + "}"


@_register(f"""SELECT id, 1000.0 * list_sum(list_transform(k, lambda p: coalesce(({_NN})[p][1], 0)))::DOUBLE / (list_sum(list_transform(k, lambda p: coalesce(({_NN})[p][2], 0)))::DOUBLE - 10.8 + 1.99 * ln(0.5e-6 / 4))
- 273.15 + 16.6 * log10(0.05::DOUBLE) AS tm FROM (SELECT id, {_KMERS.format(s='sequence', k=2)} AS k FROM ({_dna_sql()}))""")
def melting_temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dna(spark, sf_dir).select("id", S.melting_temperature(F.col("sequence")).alias("tm"))


@_register(f"""SELECT id, coalesce(bool_or(substr(sequence, i::INT, k::INT) = {_RC.format('substr(sequence, (i + k)::INT, k::INT)')}) FILTER (WHERE i + 2 * k - 1 <= 32), false) AS hairpin
FROM ({_dna_sql()}), range(4, 16) a(k), range(1, 26) b(i) GROUP BY id""")
def hairpins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_dna(spark, sf_dir)).select("id", S.hairpin(F.col("sequence")).alias("hairpin"))


@_register("""SELECT l_partkey AS key, coalesce(sum(1) FILTER (WHERE l_linestatus = 'F'), 0)::BIGINT AS "F", coalesce(sum(1) FILTER (WHERE l_linestatus = 'O'), 0)::BIGINT AS "O" FROM lineitem GROUP BY 1""")
def merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key"), F.col("l_linestatus").alias("sample")).agg(F.count("*").alias("n"))
    return tables.merge_counts(long, ["F", "O"], order="n")


@_register("""SELECT o_custkey AS key, coalesce(max_by(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'F'), 0) AS "F", coalesce(max_by(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'O'), 0) AS "O"
FROM orders GROUP BY 1""")
def last_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a sample repeats: the last value stays."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("sample"), F.col("o_totalprice").alias("n"), F.col("o_orderkey").alias("at"))
    return tables.merge_counts(rows, ["F", "O"], order="at")


@_register("""SELECT coalesce(c.k, s.k) AS key, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers
FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k""")
def appended_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda t, k, n: _table(spark, sf_dir, t).groupBy(F.col(k).alias("key")).agg(F.count("*").alias(n))
    return tables.append_column(count("customer", "c_nationkey", "customers"), count("supplier", "s_nationkey", "suppliers"))


@_register(f"""WITH d AS (SELECT sequence AS id, sum(id)::BIGINT AS n FROM ({_dna_sql(mixed=True)}) GROUP BY 1),
m AS (SELECT a.id, a.n, (SELECT b.id FROM d b WHERE length(b.id) > length(a.id) AND contains(b.id, a.id) ORDER BY length(b.id) DESC, b.id LIMIT 1) AS up FROM d a)
SELECT coalesce(up, id) AS id, sum(n)::BIGINT AS n FROM m GROUP BY 1""")
def related_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _dna(spark, sf_dir, mixed=True).groupBy(F.col("sequence")).agg(F.sum("id").alias("n")).withColumnRenamed("sequence", "id")
    return tables.merge_related(counts)


_EXONS = "SELECT user_id AS transcript, event_id * 10 AS start, event_id * 10 + 5 AS e FROM events"


@_register(f"""SELECT transcript, e + 1 AS start, nxt - 1 AS "end" FROM (SELECT transcript, e, lead(start) OVER (PARTITION BY transcript ORDER BY start, e) AS nxt FROM ({_EXONS})) WHERE nxt IS NOT NULL""")
def introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = _table(spark, sf_dir, "events").select(F.col("user_id").alias("transcript"), (F.col("event_id") * 10).alias("start"), (F.col("event_id") * 10 + 5).alias("end"))
    return mapping.introns(exons)


@_register(f"""SELECT id, s::INT AS start, e::INT AS "end", 'part' AS annotation, CASE WHEN s > e THEN {_RC_ALL.format('substr(sequence, e::INT, (s - e + 1)::INT)')} ELSE substr(sequence, s::INT, (e - s + 1)::INT) END AS sequence
FROM (SELECT id, sequence, id % 20 + 1 AS s, id % 13 + 1 AS e FROM ({_dna_sql()}))""")
def interval_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = _dna(spark, sf_dir)
    spans = seqs.select("id", (F.col("id") % 20 + 1).cast("int").alias("start"), (F.col("id") % 13 + 1).cast("int").alias("end"), F.lit("part").alias("annotation"))
    return mapping.extract_intervals(seqs, spans)


@_register(f"""WITH d AS ({_dna_sql()}), b AS (SELECT id, '+' AS strand, sequence AS s FROM d UNION ALL SELECT id, '-', {_RC.format('sequence')} FROM d),
a AS (SELECT id, strand, s, i AS start FROM b, range(1, 31) x(i) WHERE substr(s, i::INT, 3) IN ('ATG', 'TTG', 'CTG', 'GTG'))
SELECT id, strand, start, min(j) + 2 AS "end" FROM a, range(1, 31) y(j) WHERE j >= start AND (j - start) % 3 = 0 AND substr(s, j::INT, 3) IN ('TAA', 'TAG', 'TGA') GROUP BY ALL""")
def open_reading_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mapping.open_reading_frames(_dna(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("long") for c in ("start", "end")})


@_register("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'a.e') OR regexp_matches(p_name, 'red')")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", "p_name").where(S.has_keyword(F.col("p_name"), ["a.e", "red"]))


@_register("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))


@_register("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@_register(f"SELECT id, '>' || id || chr(10) || substr(sequence, 1, 20) || chr(10) || substr(sequence, 21) AS record FROM ({_dna_sql()})")
def wrapped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dna(spark, sf_dir).select("id", F.concat(F.lit(">"), F.col("id").cast("string"), F.lit("\n"), S.wrap(F.col("sequence"), 20)).alias("record"))


@_register("SELECT doc_id, (length(text) - round_even(0.85 * length(text), 0))::INT AS most FROM documents")
def mismatch_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", S.max_mismatches(F.length("text"), 0.85).alias("most"))


@_register("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5")
def longest_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.longest(_table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", 5, "doc_id")


@_register("SELECT c_custkey, CASE WHEN length(c_name) > 12 THEN substr(c_name, 1, 9) || '...' ELSE c_name END AS name FROM customer")
def truncated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", S.truncated(F.col("c_name"), 12).alias("name"))


_PROTEIN = "MLKSRAWFGVITPHQC"


def _proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.translate(F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 8), HEX, _PROTEIN).alias("protein"))


_P8 = f"SELECT s_suppkey AS id, translate(substr(md5(s_suppkey::VARCHAR), 1, 8), '{HEX}', '{_PROTEIN}') AS protein FROM supplier"
_FORMS = ", ".join(f"('{a}', '{c}')" for a, forms in C.DEGENERATE.items() for c in forms)
_ONE_FORM = "MAP {" + ", ".join(f"'{a}': '{c}'" for a, c in ({a: f[0] for a, f in C.DEGENERATE.items()} | C.MERGED).items()) + "}"


@_register(f"""WITH RECURSIVE m(a, c) AS (VALUES {_FORMS}), d AS ({_P8}),
r AS (SELECT id, protein, 0 AS k, '' AS dna FROM d UNION ALL SELECT id, protein, k + 1, dna || c FROM r JOIN m ON a = substr(protein, k + 1, 1) WHERE k < 8)
SELECT id, dna FROM r WHERE k = 8""")
def reverse_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proteins(spark, sf_dir).select("id", F.explode(C.reverse_translations(F.col("protein"))).alias("dna"))


@_register(f"SELECT id, array_to_string(list_transform(range(1, 9), lambda i: ({_ONE_FORM})[substr(protein, i, 1)]), '') AS dna FROM ({_P8})")
def reverse_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proteins(spark, sf_dir).select("id", C.reverse_translation(F.col("protein")).alias("dna"))


@_register(f"""WITH d AS (SELECT s_suppkey AS id, translate(substr(md5(s_suppkey::VARCHAR), 1, 5), '{HEX}', 'ACGTRYACGTRYACRY') AS s FROM supplier)
SELECT DISTINCT id, replace(replace(s, 'R', r), 'Y', y) AS variant FROM d, (VALUES ('A'), ('G')) a(r), (VALUES ('C'), ('T')) b(y)""")
def code_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.translate(F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 5), HEX, "ACGTRYACGTRYACRY")
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(C.expand_per_code(coded)).alias("variant"))


@_register(f"""WITH d AS (SELECT id, list_distinct({_KMERS.format(s='substr(sequence, 1, 16)', k=3)}) AS x, list_distinct({_KMERS.format(s='substr(sequence, 17)', k=3)}) AS y FROM ({_dna_sql()}))
SELECT id, len(list_intersect(x, y))::DOUBLE / greatest(len(x), len(y)) AS similarity FROM d""")
def half_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sequence")
    return _dna(spark, sf_dir).select("id", C.kmer_similarity(F.substring(s, 1, 16), F.substring(s, 17, 16), 3).alias("similarity"))


@_register(f"""WITH q AS (SELECT id, q, '+' AS strand FROM ({_Q12}) UNION ALL SELECT id, {_RC.format('q')}, '-' FROM ({_Q12})), r AS ({_dna_sql('nation', 'n_nationkey')}),
m AS (SELECT q.id AS short_id, r.id AS long_id, strand, i AS start, i + 11 AS "end", hamming(q, substr(sequence, i::INT, 12)) AS mismatch FROM q, r, range(1, 22) x(i)),
k AS (SELECT *, min(mismatch) FILTER (WHERE strand = '+') OVER (PARTITION BY short_id, long_id) AS best FROM m WHERE mismatch <= 12 - round_even(0.7 * 12, 0))
SELECT short_id, long_id, start, CASE WHEN "end" > 32 THEN "end" - 32 ELSE "end" END AS "end", mismatch, (12 - mismatch) / 12.0::DOUBLE AS similarity, 12 / 32.0::DOUBLE AS coverage, strand
FROM k WHERE strand = '+' OR best IS NULL OR mismatch < best""")
def mapped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.translate(F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 12), HEX, PLAIN).alias("sequence"))
    out = search.map_pairs(queries, _dna(spark, sf_dir, "nation", "n_nationkey"), 0.7)
    return out.withColumns({c: F.col(c).cast("long") for c in ("start", "end", "mismatch")})


_SETS = "MAP {" + ", ".join(f"'{c}': '{b}'" for c, b in S.IUPAC.items()) + "}"
#: Few letters of a reference are codes, more of a query.
_SPARSE, _HALF = "ACGTACGTACGTACGN", "ACGTACGTACGRYSWN"
_APART = "len(list_filter(range(1, {n}), lambda k: NOT list_has_any(string_split(({sets})[substr(q, k::INT, 1)], ''), string_split(({sets})[substr(s, k::INT, 1)], ''))))"


@_register(f"""WITH q AS (SELECT s_suppkey AS id, translate(substr(md5(s_suppkey::VARCHAR), 1, 20), '{HEX}', '{_HALF}') AS q FROM supplier),
b AS (SELECT id, q, '+' AS strand FROM q UNION ALL SELECT id, {_RC_ALL.format('q')}, '-' FROM q), r AS ({_dna_sql(letters=_SPARSE)}),
w AS (SELECT b.id AS short_id, r.id AS long_id, strand, i AS start, q, substr(sequence, i::INT, 20) AS s FROM b, r, range(1, 14) x(i)),
m AS (SELECT short_id, long_id, strand, start, {_APART.format(n=21, sets=_SETS)} AS mismatch FROM w),
k AS (SELECT *, min(mismatch) FILTER (WHERE strand = '+') OVER (PARTITION BY short_id, long_id) AS best FROM m WHERE mismatch <= 20 - round_even(0.95 * 20, 0))
SELECT short_id, long_id, start, mismatch::BIGINT AS mismatch, strand FROM k WHERE strand = '+' OR best IS NULL OR mismatch < best""")
def coded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes in queries and references, which both grow."""
    digest = F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 20)
    queries = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.translate(digest, HEX, _HALF).alias("sequence"))
    out = search.map_pairs(queries, _dna(spark, sf_dir, letters=_SPARSE), 0.95)
    return out.select("short_id", "long_id", F.col("start").cast("long").alias("start"), F.col("mismatch").cast("long").alias("mismatch"), "strand")


@_register(f"""WITH w AS (SELECT q.id AS query_id, r.id AS ref_id, i AS start, q, substr(sequence, i::INT, 10) AS s
FROM (SELECT s_suppkey AS id, translate(substr(md5(s_suppkey::VARCHAR), 1, 10), '{HEX}', '{_HALF}') AS q FROM supplier) q, ({_dna_sql(letters=_SPARSE)}) r, range(1, 24) x(i))
SELECT query_id, ref_id, start FROM w WHERE q = s OR len(list_filter(range(1, 11), lambda k: NOT contains(({_SETS})[substr(q, k::INT, 1)], substr(s, k::INT, 1)) OR NOT contains('ACGT', substr(s, k::INT, 1)))) = 0
OR len(list_filter(range(1, 11), lambda k: NOT contains(({_SETS})[substr(s, k::INT, 1)], substr(q, k::INT, 1)) OR NOT contains('ACGT', substr(q, k::INT, 1)))) = 0""")
def coded_mutual_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 10)
    queries = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.translate(digest, HEX, _HALF).alias("sequence"))
    return search.mutual_windows(queries, _dna(spark, sf_dir, letters=_SPARSE)).select("query_id", "ref_id", F.col("start").cast("long").alias("start"))


@_register(f"""WITH d AS ({_dna_sql()}), w AS (SELECT id, sequence, i AS start, substr(sequence, i::INT, 8) AS primer FROM d, range(1, 26) x(i) WHERE i + 7 < 12 OR i > 20),
t AS (SELECT *, 1000.0 * list_sum(list_transform(k, lambda p: coalesce(({_NN})[p][1], 0)))::DOUBLE / (list_sum(list_transform(k, lambda p: coalesce(({_NN})[p][2], 0)))::DOUBLE - 10.8 + 1.99 * ln(0.5e-6 / 4))
- 273.15 + 16.6 * log10(0.05::DOUBLE) AS tm FROM (SELECT *, {_KMERS.format(s='primer', k=2)} AS k FROM w))
SELECT id, primer, CASE WHEN start > 20 THEN 'downstream' ELSE 'upstream' END AS position, start, start + 7 AS "end", tm FROM t
WHERE tm BETWEEN -20 AND 20 AND length(sequence) - length(replace(sequence, primer, '')) = 8""")
def flanking_primers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 8 can't hold two stems of 4 under half their length, so the SQL needs no hairpin test."""
    out = search.flanking_primers(_dna(spark, sf_dir), 12, 20, 8, -20.0, 20.0)
    return out.withColumns({c: F.col(c).cast("long") for c in ("start", "end")})


_SPANS = "SELECT user_id AS id, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand, event_id * 7 % 5000 AS start, event_id * 7 % 5000 + event_id % 11 AS \"end\" FROM events"


@_register(f"""WITH s AS (SELECT DISTINCT * FROM ({_SPANS})), f AS (SELECT a.*, min(CASE WHEN b.id IS NOT NULL THEN {{'s': b.start, 'e': b."end"}} END) AS o
FROM s a LEFT JOIN s b ON a.id = b.id AND a.strand = b.strand AND a.start <= b."end" AND a."end" >= b.start AND NOT (a.start = b.start AND a."end" = b."end") GROUP BY ALL)
SELECT DISTINCT id, strand, CASE WHEN o IS NULL OR "end" - start > o.e - o.s THEN start ELSE o.s END AS start, CASE WHEN o IS NULL OR "end" - start > o.e - o.s THEN "end" ELSE o.e END AS "end" FROM f""")
def longer_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    strand = F.when(F.col("event_id") % 2 == 0, "+").otherwise("-")
    start = F.col("event_id") * 7 % 5000
    spans = _table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), strand.alias("strand"), start.alias("start"), (start + F.col("event_id") % 11).alias("end"))
    return search.keep_longer_overlaps(spans)


_DECODED = "regexp_replace(html, '<[^>]*>', '', 'g')"
for _name, _char in C.ENTITIES.items():
    _DECODED = f"replace({_DECODED}, '{_name}', chr({ord(_char)}))"


@_register(f"SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, {_DECODED} AS text FROM pages")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", responses.page_title(F.col("html")).alias("title"), C.plain_text(F.col("html")).alias("text"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _dna(spark, sf_dir)
    return a.select("id", F.col("sequence").alias("seq1")).join(a.select((F.col("id") - 1).alias("id"), F.col("sequence").alias("seq2")), "id")


@_register(f"SELECT id::VARCHAR || ' x' AS id, sequence, length(sequence)::INT AS length FROM ({_dna_sql()})")
def parsed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped, lower-case record texts read back."""
    text = F.concat(F.lit(">"), F.col("id").cast("string"), F.lit(" x\r\n"), S.wrap(F.lower("sequence"), 20), F.lit("\n"))
    return _dna(spark, sf_dir).select(fasta.fasta_record(text).alias("r")).select("r.id", "r.sequence", F.length("r.sequence").alias("length"))


@_register(f"""SELECT id, regexp_matches(sequence, '^[ATGCN]+$') AND id % 7 > 0 AND length(sequence) = 4 + id % 9 AS valid FROM ({_dna_sql(letters=CODED.replace('R', 'A'), mixed=True)})""")
def valid_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some reads have no marker and none has a quality of another length."""
    head = F.concat(F.when(F.col("id") % 7 > 0, "@").otherwise(""), F.col("id").cast("string"))
    quality = F.repeat(F.lit("I"), (F.col("id") % 9 + 4).cast("int"))
    return _dna(spark, sf_dir, letters=CODED.replace("R", "A"), mixed=True).select("id", fasta.valid_read(head, F.col("sequence"), F.lit("+"), quality).alias("valid"))


@_register(f"SELECT id, sequence FROM ({_dna_sql(letters='ACGTACGTACGTACGR')}) WHERE NOT contains(sequence, 'R')")
def plain_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dna(spark, sf_dir, letters="ACGTACGTACGTACGR").where(C.plain(F.col("sequence")))


@_register(f"""SELECT p_brand, count(*) FILTER (WHERE regexp_matches(s, '{_F}') AND regexp_matches(s, '{_R}')) AS n_matches, count(*) AS n
FROM (SELECT p_brand, translate(md5(p_partkey::VARCHAR), '{HEX}', '{PLAIN}') AS s FROM part) GROUP BY 1""")
def matching_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = _table(spark, sf_dir, "part").select("p_brand", F.translate(F.md5(F.col("p_partkey").cast("string")), HEX, PLAIN).alias("sequence"))
    return stats.matching_counts(seqs, "p_brand", mapping.primer_pair(F.col("sequence"), FORWARD, REVERSE))


@_register("""WITH f AS (SELECT l_partkey AS sample, l_linestatus AS file, count(*) FILTER (WHERE l_quantity > 25) AS n_matches, count(*) AS n_reads FROM lineitem GROUP BY 1, 2)
SELECT sample, count(DISTINCT file) AS n_files, sum(n_matches)::BIGINT AS n_matches, sum(n_reads)::BIGINT AS n_reads,
    CASE WHEN count(DISTINCT file) = 1 THEN 'SE' WHEN count(DISTINCT file) = 2 AND min(n_reads) = max(n_reads) THEN 'PE' ELSE 'UNEQUAL' END AS layout FROM f GROUP BY 1""")
def sample_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("sample"), F.col("l_linestatus").alias("file"))
    return search.sample_layout(files.agg(F.count_if(F.col("l_quantity") > 25).alias("n_matches"), F.count("*").alias("n_reads")))


@_register("SELECT vec_id, 0.7::DOUBLE * list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE AS threshold FROM embeddings")
def trace_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as traces: one channel as given, one turned over."""
    up, down = (F.transform("embedding", lambda x: (sign * x).cast("double")) for sign in (F.lit(1.0), F.lit(-1.0)))
    return _table(spark, sf_dir, "embeddings").select("vec_id", flatfiles.trace_threshold(F.create_map(F.lit("A"), up, F.lit("C"), down)).alias("threshold"))


_Q6 = f"SELECT s_suppkey AS id, translate(substr(md5(s_suppkey::VARCHAR), 1, 6), '{HEX}', '{CODED}') AS q FROM supplier"


@_register(f"""WITH w AS (SELECT q.id AS query_id, r.id AS ref_id, i AS start, i + 5 AS "end", q, substr(sequence, i::INT, 6) AS s FROM ({_Q6}) q, ({_dna_sql('nation', 'n_nationkey', CODED)}) r, range(1, 28) x(i))
SELECT query_id, ref_id, start, "end" FROM w WHERE q = s OR len(list_filter(range(1, 7), lambda k: NOT contains(({_SETS})[substr(q, k::INT, 1)], substr(s, k::INT, 1)) OR NOT contains('ACGT', substr(s, k::INT, 1)))) = 0
OR len(list_filter(range(1, 7), lambda k: NOT contains(({_SETS})[substr(s, k::INT, 1)], substr(q, k::INT, 1)) OR NOT contains('ACGT', substr(q, k::INT, 1)))) = 0""")
def mutual_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.translate(F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 6), HEX, CODED)
    queries = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), coded.alias("sequence"))
    out = search.mutual_windows(queries, _dna(spark, sf_dir, "nation", "n_nationkey", CODED))
    return out.withColumns({c: F.col(c).cast("long") for c in ("start", "end")})


@_register(f"""WITH d AS (SELECT id, sequence, reverse(substr(sequence, 9, 8)) AS s FROM ({_dna_sql()})),
w AS (SELECT id, i AS start, list_distinct({_KMERS.format(s='s', k=3)}) AS x, list_distinct(list_transform(range(1, 7), lambda j: substr(sequence, (i + j - 1)::INT, 3))) AS y FROM d, range(1, 26) z(i))
SELECT id, start, start + 7 AS "end", len(list_intersect(x, y))::DOUBLE / greatest(len(x), len(y)) AS similarity FROM w WHERE 2 * len(list_intersect(x, y)) > greatest(len(x), len(y))""")
def similar_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dna(spark, sf_dir).withColumn("part", F.reverse(F.substring("sequence", 9, 8)))
    out = search.map_windows(rows, "sequence", "part", 0.5)
    return out.select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "similarity")


@_register(f"""WITH q AS (SELECT id, q, '+' AS strand FROM ({_Q12}) UNION ALL SELECT id, {_RC.format('q')}, '-' FROM ({_Q12})), r AS ({_dna_sql('nation', 'n_nationkey')}),
m AS (SELECT q.id AS short_id, r.id AS long_id, strand, i AS start, i + 11 AS "end", hamming(q, substr(sequence || sequence, i::INT, 12)) AS mismatch FROM q, r, range(1, 33) x(i)),
k AS (SELECT *, min(mismatch) FILTER (WHERE strand = '+') OVER (PARTITION BY short_id, long_id) AS best FROM m WHERE mismatch <= 12 - round_even(0.8 * 12, 0))
SELECT short_id, long_id, start, CASE WHEN "end" > 32 THEN "end" - 32 ELSE "end" END AS "end", mismatch, (12 - mismatch) / 12.0::DOUBLE AS similarity, 12 / 32.0::DOUBLE AS coverage, strand
FROM k WHERE strand = '+' OR best IS NULL OR mismatch < best""")
def circular_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.translate(F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 12), HEX, PLAIN).alias("sequence"))
    out = search.map_pairs(queries, _dna(spark, sf_dir, "nation", "n_nationkey"), 0.8, circular=True)
    return out.withColumns({c: F.col(c).cast("long") for c in ("start", "end", "mismatch")})


@_register(f"""WITH d AS (SELECT min(id) AS id, sequence FROM ({_dna_sql(mixed=True)}) GROUP BY sequence)
SELECT id, sequence FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE length(b.sequence) > length(a.sequence) AND contains(b.sequence, a.sequence))""")
def distinct_uncontained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.drop_contained(dedup.first_per_sequence(_dna(spark, sf_dir, mixed=True), "id"))


_IUPAC_PLACES = ", ".join(f"('{c}', '{b}', {k}, {len(bases)})" for c, bases in S.IUPAC.items() for k, b in enumerate(bases))


@_register(f"""WITH RECURSIVE m(c, b, k, n) AS (VALUES {_IUPAC_PLACES}), d AS (SELECT s_suppkey AS id, translate(substr(md5(s_suppkey::VARCHAR), 1, 5), '{HEX}', '{CODED}') AS sequence FROM supplier),
r AS (SELECT id, sequence, 0 AS p, '' AS variant, 0 AS number, 1 AS stride FROM d UNION ALL SELECT id, sequence, p + 1, variant || b, number + k * stride, stride * n FROM r JOIN m ON c = substr(sequence, p + 1, 1) WHERE p < 5)
SELECT id || '_' || (number + 1) AS id, variant FROM r WHERE p = 5""")
def numbered_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids carry the variant's number; the first position varies fastest."""
    key = F.col("s_suppkey")
    coded = F.translate(F.substring(F.md5(key.cast("string")), 1, 5), HEX, CODED)
    rows = _table(spark, sf_dir, "supplier").select(key.alias("id"), F.posexplode(S.expand(coded, first_fastest=True)).alias("k", "variant"))
    return rows.select(F.concat(F.col("id").cast("string"), F.lit("_"), (F.col("k") + 1).cast("string")).alias("id"), "variant")


@_register(f"SELECT DISTINCT id, substr(protein, 1, 3) || substr(protein, k, 1) || substr(protein, 6, 1) || substr(protein, k, 1) AS variant FROM ({_P8}), (VALUES (4), (5)) x(k)")
def bracket_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("protein")
    box = F.concat(F.lit("["), F.substring(p, 4, 2), F.lit("]"))
    return _proteins(spark, sf_dir).select("id", F.explode(C.expand_brackets(F.concat(F.substring(p, 1, 3), box, F.substring(p, 6, 1), box))).alias("variant"))


_MASKS = "MAP {" + ", ".join(f"'{c}': {m}" for c, m in S.MASK.items()) + "}"


@_register(f"SELECT id, replace(sequence, 'T', 'U') AS rna, array_to_string(list_transform(range(1, 33), lambda i: ({_MASKS})[substr(sequence, i::INT, 1)]), ',') AS masks FROM ({_dna_sql(letters=CODED)})")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sequence")
    return _dna(spark, sf_dir, letters=CODED).select("id", C.transcribe(s).alias("rna"), F.array_join(S.masks(s).cast("array<string>"), ",").alias("masks"))


@_register("SELECT o_orderkey, format('{:,}', (o_orderkey * 7919)::BIGINT) AS number FROM orders")
def grouped_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", C.thousands(F.col("o_orderkey") * 7919).alias("number"))


@_register("SELECT c_custkey, CASE WHEN regexp_matches(v, '^[0-9]+$') THEN TRY_CAST(v AS BIGINT) ELSE 0 END AS n FROM (SELECT c_custkey, substr(md5(c_custkey::VARCHAR), 1, 2) AS v FROM customer)")
def read_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", source_tables.count_value(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 2)).alias("n"))


@_register("""SELECT 'q' || s_suppkey AS query, k::INT AS hit_no, 'ACC' || k AS accession, 'title ' || k AS title, (k * 0.5)::DOUBLE AS e_value, (s_suppkey + k)::DOUBLE AS bit_score,
100.0::DOUBLE * (s_suppkey * k % 50) / (50 + k) AS identity FROM supplier, range(1, 6) x(k)""")
def report_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of seven hits of a report per supplier."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    text = lambda c: c.cast("string")
    key = F.col("s_suppkey")

    def hit(k: Column) -> Column:
        hsp = F.concat(tag("Hsp_bit-score", text(key + k)), tag("Hsp_evalue", text(k * F.lit(0.5))), tag("Hsp_identity", text(key * k % 50)), tag("Hsp_align-len", text(k + 50)))
        return tag("Hit", F.concat(tag("Hit_def", F.concat(F.lit("title "), text(k))), tag("Hit_accession", F.concat(F.lit("ACC"), text(k))), tag("Hsp", hsp), tag("Hsp", tag("Hsp_evalue", F.lit("9")))))

    hits = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7)), hit), "\n")
    xml = F.concat(F.lit("<!DOCTYPE x>\n<BlastOutput>"), tag("Iteration", F.concat(tag("Iteration_query-def", F.concat(F.lit("q"), text(key))), hits)), F.lit("</BlastOutput>"))
    return responses.top_hits(responses.search_hits(_table(spark, sf_dir, "supplier").select(xml.alias("xml"))))


@_register("""SELECT 'a & b <' || s_suppkey || '>' AS query, k::INT AS hit_no, j::INT AS alignment, 'P' || k AS accession, 'x > y & ' || k AS title, (j || 'e-5')::DOUBLE AS e_value,
100.0::DOUBLE * (s_suppkey * k % 50) / (50 + j) AS identity, (s_suppkey + j)::BIGINT AS query_from FROM supplier, range(1, 4) x(k), range(1, 4) y(j) WHERE j <= k""")
def report_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested reports with entities and CDATA, hits with one to three alignments."""
    tag = lambda name, *value: F.concat(F.lit(f"<{name}>"), *value, F.lit(f"</{name}>"))
    text = lambda c: c.cast("string")
    key, many = F.col("s_suppkey"), lambda n, f: F.array_join(F.transform(F.sequence(F.lit(1), n), f), "\n")

    def hit(k: Column) -> Column:
        hsp = lambda j: tag("Hsp", tag("Hsp_num", text(j)), tag("Hsp_evalue", text(j), F.lit("e-5")), tag("Hsp_query-from", text(key + j)), tag("Hsp_identity", text(key * k % 50)), tag("Hsp_align-len", text(j + 50)))
        return tag("Hit", tag("Hit_def", F.lit("<![CDATA[x > y]]> &amp; "), text(k)), tag("Hit_accession", F.lit("P"), text(k)), tag("Hit_hsps", many(k, hsp)))

    query = tag("Iteration_query-def", F.lit("a &#38; b &lt;"), text(key), F.lit("&gt;"))
    xml = F.concat(F.lit('<?xml version="1.0"?>\n<!DOCTYPE BlastOutput PUBLIC "x" "y.dtd">\n'), tag("BlastOutput", tag("BlastOutput_iterations", tag("Iteration", query, tag("Iteration_hits", many(F.lit(3), hit))))))
    out = responses.search_alignments(_table(spark, sf_dir, "supplier").select(xml.alias("xml")))
    return out.select("query", "hit_no", "alignment", "accession", "title", "e_value", "identity", "query_from")


@_register("""SELECT c_custkey AS k, 'P' || c_custkey AS id, c_name AS protein, CASE c_custkey % 3 WHEN 2 THEN ['g' || c_nationkey] ELSE ['g' || c_nationkey, 'h'] END AS genes,
CASE c_custkey % 3 WHEN 0 THEN ['1.' || c_nationkey] END AS ec FROM customer WHERE c_custkey % 7 > 0""")
def annotation_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records alone, in a list of results, and with plain names, as one service has given them; some replies are none."""
    j = lambda **x: F.to_json(F.struct(*[v.alias(k) for k, v in x.items()]))
    s = lambda **x: F.struct(*[v.alias(k) for k, v in x.items()])
    gene, id_ = F.concat(F.lit("g"), F.col("c_nationkey")), F.concat(F.lit("P"), F.col("c_custkey"))
    full = s(fullName=s(value=F.col("c_name")))
    first = s(recommendedName=s(fullName=s(value=F.col("c_name")), ecNumbers=F.array(s(value=F.concat(F.lit("1."), F.col("c_nationkey"))))))
    shapes = [
        j(results=F.array(s(primaryAccession=id_, proteinDescription=first, genes=F.array(s(geneName=s(value=gene)), s(geneName=s(value=F.lit("h"))))))),
        j(primaryAccession=id_, proteinDescription=s(submissionNames=F.array(full)), genes=F.array(gene, F.lit("h"))),
        j(primaryAccession=id_, protein=F.col("c_name"), genes=F.array(s(orfNames=F.array(s(value=gene))))),
    ]
    key = F.col("c_custkey")
    reply = F.when(key % 7 == 0, F.when(key % 2 == 0, '{"results": []}').otherwise("<html>")).when(key % 3 == 0, shapes[0]).when(key % 3 == 1, shapes[1]).otherwise(shapes[2])
    return _table(spark, sf_dir, "customer").select(key.alias("k"), responses.annotation_of(reply).alias("a")).where("a IS NOT NULL").select("k", "a.*")


@_register("SELECT s_suppkey, 'R' || s_suppkey AS rid, (s_suppkey % 60)::INT AS wait, CASE WHEN s_suppkey % 2 = 0 THEN 'READY' END AS status FROM supplier")
def job_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    status = F.when(key % 2 == 0, "\n Status=READY\n").otherwise("")
    page = F.concat(F.lit("<!--\n RID = R"), key.cast("string"), F.lit("\n RTOE = "), (key % 60).cast("string"), status, F.lit("\n-->"))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", responses.job_ticket(page).alias("t")).select("s_suppkey", "t.rid", "t.wait", "t.status")


@_register("""WITH e AS (SELECT c_custkey AS k, i, i * 100 + c_custkey % 7 AS s, i * 100 + c_custkey % 7 + 20 + i AS e FROM customer, range(1, 6) x(i) WHERE i <= c_custkey % 5 + 1)
SELECT 'g' || a.k AS gene, 'human' AS species, 't' || a.k AS transcript, CASE WHEN a.k % 2 = 0 THEN '+' ELSE '-' END AS strand, a.e + 1 AS start, b.s - 1 AS "end" FROM e a JOIN e b ON a.k = b.k AND b.i = a.i + 1""")
def gene_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons come last first, as on a reverse strand."""
    key = F.col("c_custkey")
    exons = F.transform(F.reverse(F.sequence(F.lit(1), (key % 5 + 1).cast("int"))), lambda i: F.struct((i * 100 + key % 7).alias("start"), (i * 100 + key % 7 + 20 + i).alias("end")))
    one = F.struct(F.concat(F.lit("t"), key.cast("string")).alias("id"), F.when(key % 2 == 0, 1).otherwise(-1).alias("strand"), exons.alias("Exon"))
    gene = F.to_json(F.struct(F.concat(F.lit("g"), key.cast("string")).alias("display_name"), F.lit("human").alias("species"), F.array(one).alias("Transcript")))
    return responses.gene_introns(_table(spark, sf_dir, "customer").select(gene.alias("json")))


@_register("""WITH p AS (SELECT c_custkey AS id, c_custkey % 10 > 0 AS found, CASE WHEN c_custkey % 4 = 0 THEN 'NA' ELSE c_nationkey::VARCHAR END AS code, c_name AS title, c_mktsegment AS drug FROM customer)
SELECT id, code, title AS disease, coalesce(n_name, 'NA') AS usa, coalesce(n_regionkey::VARCHAR, 'NA') AS world, (id % 3)::VARCHAR AS n_drugs, drug, 'NA' AS synonyms, 'c' || id AS chemical
FROM p LEFT JOIN nation ON n_nationkey::VARCHAR = code AND n_nationkey < 20 WHERE found AND id % 3 > 0
UNION ALL SELECT id, 'NA', 'NA', 'NA', 'NA', 'NA', 'NA', 'NA', 'NA' FROM p WHERE NOT found""")
def disease_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages built from customers: some failed, some without drugs, some without a code."""
    key, text = F.col("c_custkey"), lambda c: F.col(c).cast("string")
    code = lambda system, value: F.concat(F.lit(f'{{"codingSystem": "{system}", "codeValue": "'), value, F.lit('"}'))
    codes = F.concat(code("OMIM", F.lit("1")), F.when(key % 4 == 0, "").otherwise(F.concat(F.lit(", "), code("GARD", text("c_nationkey")))))
    html = F.concat(
        F.lit("<title>Disease: "), "c_name", F.lit('</title>\n<script type="application/ld+json">\n{"code": ['), codes, F.lit("]}\n</script><a>orphan drug(s) ("), (key % 3).cast("string"), F.lit(")</a>")
    )
    customers = _table(spark, sf_dir, "customer")
    pages = customers.select(key.alias("id"), F.when(key % 10 > 0, html).alias("html"))
    estimates = _table(spark, sf_dir, "nation").where("n_nationkey < 20").select(text("n_nationkey").alias("code"), F.col("n_name").alias("usa"), text("n_regionkey").alias("world"))
    drugs = customers.where(key % 3 > 0).select(key.alias("id"), F.col("c_mktsegment").alias("drug"), F.lit(None).cast("string").alias("synonyms"), F.concat(F.lit("c"), key.cast("string")).alias("chemical"))
    return responses.disease_rows(pages, estimates, drugs, "Disease: ")


@_register(f"""SELECT 'gene|g' || id || '|+|3..9' AS id, substr(sequence, 3, 7) AS sequence, NULL::VARCHAR AS quality FROM ({_dna_sql()})
UNION ALL SELECT 'CDS|c' || id || '|-|5..12', {_RC.format('substr(sequence, 5, 8)')}, NULL FROM ({_dna_sql()})""")
def feature_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three features a record, one of them without a name."""
    name = lambda c: F.concat(F.lit(c), F.col("id").cast("string"))
    feature = lambda *v: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in zip(("type", "name", "strand", "start", "end"), v, strict=True)])
    features = F.array(feature("gene", name("g"), "+", 3, 9), feature("CDS", name("c"), "-", 5, 12), feature("CDS", F.lit(None).cast("string"), "-", 1, 2))
    return flatfiles.feature_records(_dna(spark, sf_dir).select("sequence", features.alias("features")))


@_register("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def unvisited_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = _table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("id"))
    return stats.unseen(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), large, "id")


@_register("SELECT DISTINCT source, lang FROM documents")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("source", "lang").distinct()


@_register("SELECT max(length(c_name))::INT AS c_name, max(length(c_mktsegment))::INT AS c_mktsegment FROM customer")
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.column_widths(_table(spark, sf_dir, "customer").select("c_name", "c_mktsegment"))


def _load() -> None:
    """The other modules of queries register theirs when they are imported."""
    from helixframe.plans import readers, scores  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
