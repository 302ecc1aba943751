"""Registered queries that write files from a table and read them back, and queries of sinks, streams and small operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.functions import tables as table_functions
from helixframe.operators import crawl, kmers, search, stats, variants
from helixframe.plans.registry import CODED, HEX, PLAIN, _dna, _dna_sql, _RC, _register, _table
from helixframe.sources import fasta, flatfiles, responses, sinks
from helixframe.sources import tables as source_tables
from helixframe.sources.scratch import new_folder
from helixframe.streaming import records

_TEXT = "string"


def _written(rows: DataFrame, value: Column, label: str, files: int | None = None) -> str:
    """Folder of text files of the rows, in as many files as tasks or as told."""
    path = new_folder(rows.sparkSession, label)
    out = rows.select(value.alias("value"))
    (out.repartition(files) if files else out).write.text(path)
    return path


def _fasta(extra: str = "", lower: bool = False) -> Column:
    s = F.lower("sequence") if lower else F.col("sequence")
    return F.concat(F.lit(">"), F.col("id").cast(_TEXT), F.lit(extra + "\n"), S.wrap(s, 20))


@_register(f"SELECT id || ' x' AS id, sequence FROM ({_dna_sql()})")
def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(_dna(spark, sf_dir), _fasta(" x", lower=True), "fasta", 3)
    return fasta.read_fasta(spark, path).select("id", "sequence")


@_register(f"SELECT id::VARCHAR AS id, lower(sequence) AS sequence FROM ({_dna_sql()})")
def cased_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(_dna(spark, sf_dir), _fasta(lower=True), "fasta")
    return fasta.read_fasta(spark, path, keep_case=True).select("id", "sequence")


@_register(f"SELECT id::VARCHAR AS id, substr(sequence, 1, 20) AS sequence FROM ({_dna_sql()}) UNION ALL SELECT id::VARCHAR, substr(sequence, 21) FROM ({_dna_sql()})")
def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(_dna(spark, sf_dir), _fasta(" y"), "fasta")
    return fasta.read_fasta(spark, path, one_line_per_record=True).select("id", "sequence")


@_register(f"SELECT (id % 50)::VARCHAR AS id, max_by(sequence, id) AS sequence FROM ({_dna_sql()}) GROUP BY 1")
def last_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids come again in one file, in the order of the keys."""
    rows = _dna(spark, sf_dir).repartition(1).sortWithinPartitions("id").withColumn("id", F.col("id") % 50)
    return fasta.last_per_id(fasta.read_fasta(spark, _written(rows, _fasta(), "fasta"))).select("id", "sequence")


@_register(f"SELECT min_by(id::VARCHAR, id) AS id, sequence, length(sequence)::INT AS n FROM ({_dna_sql(mixed=True)}) GROUP BY sequence")
def dedup_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dna(spark, sf_dir, mixed=True).repartition(1).sortWithinPartitions("id")
    return fasta.read_dedup(spark, _written(rows, _fasta(), "fasta")).select("id", "sequence", F.length("sequence").alias("n"))


_READ = "CASE WHEN id % 5 = 0 THEN sequence || 'X' ELSE sequence END"


@_register(f"SELECT 'r' || id AS id, {_READ} AS sequence, repeat('I', 32) AS quality, id % 5 > 0 AS valid FROM ({_dna_sql()})")
def fastq_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth read is one base longer than its quality."""
    seq = F.concat("sequence", F.when(F.col("id") % 5 == 0, "X").otherwise(""))
    value = F.concat(F.lit("@r"), F.col("id").cast(_TEXT), F.lit("\n"), seq, F.lit("\n+\n" + "I" * 32))
    return fasta.read_fastq(spark, _written(_dna(spark, sf_dir), value, "fastq")).select("id", "sequence", "quality", "valid")


@_register(f"SELECT 'r' || id AS id, CASE WHEN id % 5 = 0 THEN '@r' || id || chr(10) || sequence || 'X' || chr(10) || '+' || chr(10) || repeat('I', 32) END AS corrupt FROM ({_dna_sql()})")
def corrupt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken reads keep their text; files are read in ranges of a few records."""
    seq = F.concat("sequence", F.when(F.col("id") % 5 == 0, "X").otherwise(""))
    value = F.concat(F.lit("@r"), F.col("id").cast(_TEXT), F.lit("\n"), seq, F.lit("\n+\n" + "I" * 32))
    rows = fasta.read_fastq(spark, _written(_dna(spark, sf_dir), value, "fastq"), range_bytes=64 << 10)
    return rows.select("id", F.col("_corrupt_record").alias("corrupt"))


@_register(f"SELECT id::VARCHAR AS id, sequence, CASE WHEN id % 2 = 0 THEN repeat('J', 32) END AS quality FROM ({_dna_sql()})")
def mixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of FASTA files and one of FASTQ files, written as records and told apart by their first letters."""
    base = new_folder(spark, "records")
    rows = _dna(spark, sf_dir).select(F.col("id").cast(_TEXT).alias("id"), "sequence", F.when(F.col("id") % 2 == 0, F.repeat(F.lit("J"), F.lit(32))).alias("quality"))
    fasta.write_records(rows.where("quality IS NULL"), f"{base}/fasta", width=20)
    fasta.write_records(rows.where("quality IS NOT NULL"), f"{base}/fastq", compression="gzip")
    return fasta.read_sequences(spark, f"{base}/*").select("id", "sequence", "quality")


@_register(f"SELECT id::VARCHAR AS id, upper(protein) AS sequence FROM (SELECT s_suppkey AS id, translate(substr(md5(s_suppkey::VARCHAR), 1, 8), '{HEX}', 'MLKSRAWFGVITPHQC') AS protein FROM supplier)")
def protein_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    rows = _table(spark, sf_dir, "supplier").select(key.alias("id"), F.translate(F.substring(F.md5(key.cast(_TEXT)), 1, 8), HEX, "MLKSRAWFGVITPHQC").alias("sequence"))
    return fasta.read_proteins(spark, _written(rows, _fasta(lower=True), "fasta")).select("id", "sequence")


@_register("SELECT 'k' || c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey * 7 END AS n FROM customer WHERE c_custkey % 10 > 0")
def count_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some counts are no numbers, some rows have one column."""
    key = F.col("c_custkey")
    number = F.when(key % 3 == 0, "n/a").otherwise((key * 7).cast(_TEXT))
    value = F.concat(F.lit("k"), key.cast(_TEXT), F.when(key % 10 > 0, F.concat(F.lit("\t"), number)).otherwise(""))
    return source_tables.read_counts(spark, _written(_table(spark, sf_dir, "customer"), value, "counts")).select("key", "n")


@_register("SELECT c_name AS id, (c_custkey % 90 + 1)::INT AS start, (c_custkey % 70 + 3)::INT AS \"end\", c_mktsegment AS annotation FROM customer")
def interval_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by the table sink, read as intervals."""
    key, path = F.col("c_custkey"), new_folder(spark, "intervals")
    rows = _table(spark, sf_dir, "customer").select("c_name", (key % 90 + 1).alias("start"), (key % 70 + 3).alias("end"), "c_mktsegment")
    sinks.write_table(rows, path, header=False)
    return source_tables.read_intervals(spark, path)


@_register("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(_table(spark, sf_dir, "customer"), F.col("c_mktsegment"), "lines")
    return stats.value_counts(spark.read.text(path), "value")


@_register("SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part")
def table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "table")
    sinks.write_json(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size")), path, compression="gzip")
    return spark.read.schema("id bigint, name string, size int").json(path).select("id", "name", F.col("size").cast(_table(spark, sf_dir, "part").schema["p_size"].dataType).alias("size"))


@_register("SELECT '| ' || rpad(c_custkey::VARCHAR, 9, ' ') || ' | ' || rpad(c_mktsegment, 12, ' ') || ' |' AS line FROM customer")
def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return rows.select(sinks.markdown_row(rows, {"c_custkey": 9, "c_mktsegment": 12}).alias("line"))


@_register(f"""SELECT id, '   1 ' || substr(sequence, 1, 20) || chr(10) || '     ' || m1 || chr(10) || '   1 ' || substr(other, 1, 20) || chr(10) || chr(10)
|| '  21 ' || substr(sequence, 21) || chr(10) || '     ' || m2 || chr(10) || '  21 ' || substr(other, 21) || chr(10) AS text
FROM (SELECT *, substr(m, 1, 20) AS m1, substr(m, 21) AS m2 FROM (SELECT id, sequence, other, array_to_string(list_transform(range(1, 33), lambda i: CASE WHEN substr(other, i::INT, 1) = '-' THEN ' ' WHEN substr(sequence, i::INT, 1) = substr(other, i::INT, 1) THEN '|' ELSE '.' END), '') AS m
FROM (SELECT id, sequence, reverse(replace(sequence, 'T', '-')) AS other FROM ({_dna_sql()}))))""")
def alignment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.reverse(F.replace("sequence", F.lit("T"), F.lit("-")))
    return _dna(spark, sf_dir).select("id", sinks.aligned_text(F.col("sequence"), other, 20).alias("text"))


@_register(f"SELECT 'p' || id AS name, 32::BIGINT AS size, lower(sequence) AS sequence, 'CDS' AS type, 'g' || id AS gene, 3 AS start, 9 AS \"end\", '-' AS strand FROM ({_dna_sql()})")
def genbank_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, s = F.col("id").cast(_TEXT), F.lower("sequence")
    text = F.concat(
        F.lit("LOCUS       p"), key, F.lit("   32 bp    DNA     circular SYN 05-MAR-2020\nDEFINITION  made.\nFEATURES             Location/Qualifiers\n     CDS             complement(3..9)\n                     /gene=\"g"), key,
        F.lit('"\nORIGIN\n        1 '), F.substring(s, 1, 10), F.lit(" "), F.substring(s, 11, 10), F.lit(" "), F.substring(s, 21, 12), F.lit("\n//"),
    )
    rows = flatfiles.read_genbank(spark, _written(_dna(spark, sf_dir), text, "genbank"))
    f = F.get("features", 0)
    return rows.select("name", "size", "sequence", f["type"].alias("type"), f["name"].alias("gene"), f["start"].alias("start"), f["end"].alias("end"), f["strand"].alias("strand"))


def _hex(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-8"))


def _block(tag: str, body: Column) -> Column:
    """Hex digits of a tagged block."""
    return F.concat(F.lit(tag), F.lpad(F.hex(F.length(body) / 2), 8, "0"), body)


@_register(f"SELECT id::VARCHAR AS file, sequence, CASE WHEN id % 2 = 0 THEN 'linear' ELSE 'circular' END AS topology, 'f' || id AS name, 2 AS start, (4 + id % 5)::INT AS \"end\", '+' AS strand FROM ({_dna_sql()})")
def plasmid_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary plasmid files built from keys."""
    key = F.col("id")
    xml = F.concat(F.lit('<Features><Feature name="f'), key.cast(_TEXT), F.lit('" type="CDS" directionality="1"><Segment range="2-'), (4 + key % 5).cast(_TEXT), F.lit('"/></Feature></Features>'))
    dna = F.concat(F.when(key % 2 == 0, "02").otherwise("03"), _hex(F.col("sequence")))
    data = F.concat(F.lit("090000000E"), _hex(F.lit("SnapGene")), F.lit("000100020003"), _block("00", dna), _block("07", F.lit("0000")), _block("0A", _hex(xml)))
    rows = flatfiles.snapgene_rows(_dna(spark, sf_dir).select(F.unhex(data).alias("content"), key.cast(_TEXT).alias("file")))
    f = F.get("features", 0)
    return rows.select("file", "sequence", "topology", f["name"].alias("name"), f["start"].alias("start"), f["end"].alias("end"), f["strand"].alias("strand"))


@_register(f"SELECT id::VARCHAR AS file, sequence AS bases, 0.7::DOUBLE * (id % 100 + 10) AS threshold FROM ({_dna_sql()})")
def trace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary traces of three entries built from keys: bases behind the head, channel order and one channel inside the directory."""
    entry = lambda tag, number, kind, size, n, length, value: F.concat(_hex(F.lit(tag)), F.lit(f"{number:08X}{kind:04X}{size:04X}{n:08X}{length:08X}"), value, F.lit("00000000"))
    peak = F.concat(F.lpad(F.hex(F.col("id") % 100 + 10), 4, "0"), F.lit("0001"))
    head = F.concat(_hex(F.lit("ABIF")), F.lit("0065"), _hex(F.lit("tdir")), F.lit(f"{1:08X}{1023:04X}{28:04X}{3:08X}{84:08X}{66:08X}"))
    body = F.concat(_hex(F.col("sequence")), entry("PBAS", 2, 2, 1, 32, 32, F.lit(f"{34:08X}")), entry("FWO_", 1, 2, 1, 4, 4, _hex(F.lit("GATC"))), entry("DATA", 9, 4, 2, 2, 4, peak))
    data = F.concat(F.rpad(head, 68, "0"), body)
    rows = flatfiles.trace_rows(_dna(spark, sf_dir).select(F.unhex(data).alias("content"), F.col("id").cast(_TEXT).alias("file")))
    return rows.select("file", "bases", flatfiles.trace_threshold(F.col("channels")).alias("threshold"))


@_register("SELECT 'f' || s_suppkey AS function, 'a, b' AS args, 'int' AS returns, CASE WHEN s_suppkey % 2 = 0 THEN 'json, os' ELSE 'json' END AS dependencies FROM supplier")
def script_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    body = F.when(key % 2 == 0, "o.getpid() + j(a)").otherwise("j(b)")
    text = F.concat(F.lit("import os as o, re\nfrom json import loads as j\ndef f"), key.cast(_TEXT), F.lit("(a, b) -> int:\n    return "), body, F.lit("\n"))
    return flatfiles.function_rows(_table(spark, sf_dir, "supplier").select(text.alias("value"), F.lit("a.py").alias("file"))).select("function", "args", "returns", "dependencies")


@_register(f"SELECT DISTINCT sequence FROM ({_dna_sql(mixed=True)})")
def streamed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder read as a stream until all is read; each sequence once."""
    path, out = _written(_dna(spark, sf_dir, mixed=True), _fasta(), "stream", 2), new_folder(spark, "streamed")
    stream = records.stream_distinct(records.stream_fasta(spark, path)).select("sequence")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("sequence string").parquet(out)


@_register(f"""WITH d AS ({_dna_sql()}), b AS (SELECT id, '+' AS strand, sequence AS s FROM d UNION ALL SELECT id, '-', {_RC.format('sequence')} FROM d),
a AS (SELECT id, strand, s, i AS start FROM b, range(1, 31) x(i) WHERE substr(s, i::INT, 3) IN ('ATG', 'TTG', 'CTG', 'GTG')),
o AS (SELECT id, strand, start, min(j) + 2 AS e FROM a, range(1, 31) y(j) WHERE j >= start AND (j - start) % 3 = 0 AND substr(s, j::INT, 3) IN ('TAA', 'TAG', 'TGA') GROUP BY ALL),
m AS (SELECT id, strand, CASE WHEN strand = '-' THEN 33 - e ELSE start END AS start, CASE WHEN strand = '-' THEN 33 - start ELSE e END AS e FROM o),
f AS (SELECT m.*, min(CASE WHEN n.id IS NOT NULL THEN {{'s': n.start, 'e': n.e}} END) AS x FROM m LEFT JOIN m n ON m.id = n.id AND m.strand = n.strand AND m.start <= n.e AND m.e >= n.start AND NOT (m.start = n.start AND m.e = n.e) GROUP BY ALL),
k AS (SELECT DISTINCT id, strand, CASE WHEN x IS NULL OR e - start > x.e - x.s THEN start ELSE x.s END AS start, CASE WHEN x IS NULL OR e - start > x.e - x.s THEN e ELSE x.e END AS e FROM f)
SELECT id, strand, start, e AS "end", e - start + 1 AS n, CASE WHEN strand = '-' THEN {_RC.format('substr(sequence, start::INT, (e - start + 1)::INT)')} ELSE substr(sequence, start::INT, (e - start + 1)::INT) END AS sequence FROM k JOIN d USING (id)""")
def found_orfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In forward coordinates; sorted by place."""
    out = search.find_orfs(_dna(spark, sf_dir))
    return sinks.by_place(out).withColumns({c: F.col(c).cast("long") for c in ("start", "end", "n")})


@_register(f"SELECT id, {', '.join(f'(32 - length(replace(sequence, {chr(39)}{b}{chr(39)}, {chr(39) * 2})))::DOUBLE / 32 AS {b.lower()}' for b in 'ATGC')} FROM ({_dna_sql()})")
def base_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dna(spark, sf_dir).select("id", S.base_frequencies(F.col("sequence")).alias("f")).select("id", "f.*")


@_register("SELECT o_orderstatus AS file, o_custkey AS id, sum(length(o_orderpriority))::BIGINT AS length FROM orders GROUP BY 1, 2")
def record_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("file"), F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("sequence"))
    return stats.record_lengths(rows)


@_register(f"""WITH d AS ({_dna_sql(mixed=True)}), k AS (SELECT id, unnest(list_transform(range(1, length(sequence) - 2), lambda i: substr(sequence, i, 4))) AS kmer FROM d)
SELECT id, sequence FROM d WHERE id IN (SELECT id FROM k WHERE kmer IN (SELECT kmer FROM k GROUP BY 1 HAVING count(*) > 1))""")
def shared_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mers as long as the shortest sequence, four letters."""
    return kmers.repeated_kmer(_dna(spark, sf_dir, mixed=True))


@_register(f"SELECT id || '_' || lpad((k + 1)::VARCHAR, 4, '0') AS id, variant FROM (SELECT id, k, replace(replace(replace(sequence, 'R', substr('AG', (k // 2 + 1)::INT, 1)), 'Y', substr('CT', (k % 2 + 1)::INT, 1)), '-', '') AS variant FROM (SELECT id, 'R' || substr(sequence, 1, 4) || 'Y' AS sequence FROM ({_dna_sql('supplier', 's_suppkey')})), range(0, 4) x(k))")
def padded_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants as rows, decoded from their numbers."""
    rows = _dna(spark, sf_dir, "supplier", "s_suppkey").select("id", F.concat(F.lit("R"), F.substring("sequence", 1, 4), F.lit("Y")).alias("s"))
    out = variants.variant_rows(rows, variants.iupac_choices(F.col("s")))
    return out.select(S.numbered_id(F.col("id"), F.col("number") + 1, 4).alias("id"), "variant")


@_register("SELECT 'g' || s_suppkey AS name, s_suppkey::VARCHAR AS synonyms, 'NA' AS chemical, ['https://h/en/drug/substance/' || s_suppkey] AS links FROM supplier")
def card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast(_TEXT)
    html = F.concat(
        F.lit('<div class="result-detail"><h2>g'), key, F.lit('</h2></div><div class="col-6"><p>Code/Synonyms: <span class="fw-bold"> '), key,
        F.lit('</span></p></div><div class="a drug-card"><a href="/x">x</a><a href="/en/drug/substance/'), key, F.lit('">d</a></div><div class="drug-card"></div>'),
    )
    fields = responses.card_fields(html, {"synonyms": "Code/Synonyms:", "chemical": "Chemical name or description:"})
    return _table(spark, sf_dir, "supplier").select(fields.alias("f"), responses.card_links(html, base="https://h").alias("links")).select("f.*", "links")


@_register("SELECT 'P' || s_suppkey AS id, 'n' || s_suppkey AS protein, ['g' || s_suppkey] AS genes FROM supplier WHERE s_suppkey % 4 > 0")
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the results of recorded searches; some have none."""
    key = F.col("s_suppkey").cast(_TEXT)
    one = lambda k: F.concat(F.lit('{"primaryAccession":"P'), k, F.lit('","genes":[{"geneName":{"value":"g'), k, F.lit('"}}],"proteinDescription":{"recommendedName":{"fullName":{"value":"n'), k, F.lit('"}}}}'))
    json = F.concat(F.lit('{"results":['), F.when(F.col("s_suppkey") % 4 > 0, F.concat_ws(",", one(key), one(F.lit("0")))).otherwise(""), F.lit("]}"))
    rows = _table(spark, sf_dir, "supplier").select(responses.annotation(json).alias("a")).where("a IS NOT NULL")
    return rows.select("a.id", "a.protein", "a.genes")


@_register("SELECT s_suppkey AS id, line FROM supplier, (VALUES ('hit 1'), ('hit 2')) x(line)")
def lines_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("head "), F.col("s_suppkey").cast(_TEXT), F.lit("\nQueryID 1\nhit 1\n# note\nhit 2\n\nhit 3\n"))
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(responses.lines_after(text, "QueryID", 4)).alias("line"))


@_register("SELECT doc_id, format('{:.2f}', 100.0::DOUBLE * (doc_id % 1000) / 1000.0) AS share FROM documents")
def percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", S.percent_text((F.col("doc_id") % 1000) / F.lit(1000.0)).alias("share"))


@_register("SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'fasta' WHEN 1 THEN 'fastq' ELSE 'unknown' END AS kind, CASE s_suppkey % 3 WHEN 0 THEN 's' || s_suppkey WHEN 1 THEN 's' || s_suppkey ELSE 's' || s_suppkey || '.txt' END AS sample FROM supplier")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    ending = F.when(key % 3 == 0, ".fa.gz").when(key % 3 == 1, "_R2.fastq.gz").otherwise(".txt")
    path = F.concat(F.lit("/data/x/s"), key.cast(_TEXT), ending)
    return _table(spark, sf_dir, "supplier").select(key.alias("id"), fasta.file_kind(path).alias("kind"), fasta.sample_name(path).alias("sample"))


_RNA = "MAP {" + ", ".join(f"'{p}': [{h}, {s}]" for p, (h, s) in S.NEAREST_NEIGHBOUR_RNA.items()) + "}"


@_register(f"""SELECT id, 1000.0 * list_sum(list_transform(k, lambda p: coalesce(({_RNA})[p][1], 0)))::DOUBLE / (list_sum(list_transform(k, lambda p: coalesce(({_RNA})[p][2], 0)))::DOUBLE - 10.8 + 1.99 * ln(0.5e-6 / 4))
- 273.15 + 16.6 * log10(0.05::DOUBLE) AS tm FROM (SELECT id, list_transform(range(1, 32), lambda i: substr(sequence, i, 2)) AS k FROM ({_dna_sql()}))""")
def rna_melting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dna(spark, sf_dir).select("id", S.melting_temperature(F.col("sequence"), table=S.NEAREST_NEIGHBOUR_RNA).alias("tm"))


@_register(f"""WITH q AS (SELECT s_suppkey AS id, translate(substr(md5(s_suppkey::VARCHAR), 1, 12), '{HEX}', '{PLAIN}') AS q FROM supplier), r AS ({_dna_sql('nation', 'n_nationkey')}),
m AS (SELECT q.id AS short_id, r.id AS long_id, i AS start, hamming(q, substr(sequence, i::INT, 12)) AS d FROM q, r, range(1, 22) x(i))
SELECT short_id, long_id, start, (12 - d) / 12.0::DOUBLE AS similarity FROM m WHERE d <= 12 - round_even(0.8 * 12, 0)""")
def ranked_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on the given strand only, the most similar first."""
    key = F.col("s_suppkey")
    queries = _table(spark, sf_dir, "supplier").select(key.alias("id"), F.translate(F.substring(F.md5(key.cast(_TEXT)), 1, 12), HEX, PLAIN).alias("sequence"))
    out = search.map_pairs(queries, _dna(spark, sf_dir, "nation", "n_nationkey"), 0.8, nucleotide=False)
    return sinks.by_similarity(out.select("short_id", "long_id", F.col("start").cast("long").alias("start"), "similarity"))


@_register(f"SELECT id, len(list_filter(range(1, 33), lambda i: contains('RYSWKMBDHVN', substr(sequence, i::INT, 1))))::INT AS n_codes FROM ({_dna_sql(letters=CODED)})")
def code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters with more than one base, by their masks."""
    return _dna(spark, sf_dir, letters=CODED).select("id", F.size(F.filter(S.masks(F.col("sequence")), lambda m: ~m.isin(1, 2, 4, 8))).alias("n_codes"))


@_register("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"(https?://[^\"]*)\"', 1)) AS link FROM pages")
def outer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(responses.links(F.col("html"), 'https?://[^"]*')).alias("link"))


_LINKS = """(SELECT page_id, (unicode(substr(link, 2, 1)) * 31 + length(link) * 7 + page_id * 3) % (SELECT count(*) FROM pages) AS target
FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]+)"', 1)) AS link FROM pages))"""


@_register(f"""WITH RECURSIVE l AS MATERIALIZED (SELECT DISTINCT * FROM {_LINKS}),
r AS (SELECT 0::BIGINT AS page_id, 0 AS round UNION SELECT l.target, r.round + 1 FROM r JOIN l USING (page_id) WHERE r.round < 30)
SELECT page_id, min(round)::INT AS round FROM r GROUP BY 1""")
def reached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages reached from page 0, each link read as the number of a page."""
    pages = _table(spark, sf_dir, "pages")
    link = F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]+)"'), F.lit(1)))
    many = pages.select(F.count("*").alias("many"))
    target = (F.ascii(F.substring("link", 2, 1)) * 31 + F.length("link") * 7 + F.col("page_id") * 3) % F.col("many")
    links = pages.select("page_id", link.alias("link")).join(F.broadcast(many)).select("page_id", target.alias("target"))  # one row
    out = crawl.crawl(spark.range(1), lambda ids: links.join(ids, links.page_id == ids.id, "left_semi").select(F.col("target").alias("id")), rounds=30)
    return out.select(F.col("id").alias("page_id"), "round")


@_register("""WITH s AS (SELECT l_suppkey AS suppkey, l_orderkey AS start, l_orderkey + l_linenumber * 3 AS e FROM lineitem),
m AS (SELECT *, CASE WHEN start <= max(e) OVER (PARTITION BY suppkey ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 41 THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY suppkey ORDER BY start, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT suppkey, min(start)::BIGINT AS start, max(e)::BIGINT AS "end", count(*)::INT AS n FROM i GROUP BY suppkey, island""")
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL text alone over a table function with a partitioned and ordered TABLE argument."""
    rows = _table(spark, sf_dir, "lineitem")
    rows.createOrReplaceTempView("helixframe_lineitem")
    table_functions.register(spark, f"suppkey {rows.schema['l_suppkey'].dataType.simpleString()}")
    out = spark.sql("""
        SELECT * FROM merged_spans(
            TABLE(SELECT l_suppkey AS suppkey, l_orderkey AS start, l_orderkey + l_linenumber * 3 AS `end` FROM helixframe_lineitem)
            PARTITION BY suppkey ORDER BY (start, `end`), 40)""")
    table_functions.register(spark)  # for tables of any columns
    return out


@_register(f"""SELECT kmer, count(*) AS n, count(DISTINCT id % 3) AS n_files FROM (SELECT id, unnest(list_transform(range(1, 29), lambda i: substr(sequence, i, 5))) AS kmer FROM ({_dna_sql()})) GROUP BY 1""")
def growing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over a folder that gets its third file late; the last counts of each k-mer."""
    rows, path, out = _dna(spark, sf_dir), new_folder(spark, "growing"), new_folder(spark, "grown")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for number, some in enumerate((rows.where("id % 3 < 2"), rows.where("id % 3 = 2"))):
            parts = some.select((F.col("id") % 3).alias("file"), _fasta().alias("value")).repartition(2, "file")
            parts.write.mode("append").partitionBy("file").text(path)
            stream = records.stream_kmer_counts(spark, f"{path}/*", 5)
            write = lambda batch, at, number=number: batch.withColumn("at", F.lit(number * 1000 + at)).write.mode("overwrite").parquet(f"{out}/run={number}/batch={at}")
            stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)
    held = spark.read.schema("kmer string, n long, n_files long, at int").option("recursiveFileLookup", "true").parquet(out)
    return held.groupBy("kmer").agg(F.max_by(F.struct("n", "n_files"), "at").alias("c")).select("kmer", "c.*")
