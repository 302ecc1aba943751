"""Recorded responses of remote services as rows, and a batched fetcher that takes the transport as a function."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.coding import percent_identity, plain_text
from helixframe.functions.sequence import bind, truncated
from helixframe.operators.pieces import record_key
from helixframe.sources.scratch import new_folder


_HSP = "struct<`Hsp_num`: int, `Hsp_bit-score`: double, `Hsp_evalue`: double, `Hsp_identity`: bigint, `Hsp_align-len`: bigint, `Hsp_query-from`: bigint, `Hsp_query-to`: bigint, `Hsp_hit-from`: bigint, `Hsp_hit-to`: bigint, `Hsp_qseq`: string, `Hsp_hseq`: string>"
_HIT = f"struct<Hit_id: string, Hit_def: string, Hit_accession: string, Hit_len: bigint, Hsp: array<{_HSP}>, Hit_hsps: struct<Hsp: array<{_HSP}>>>"
_ROUND = f"struct<`Iteration_query-def`: string, Hit: array<{_HIT}>, Iteration_hits: struct<Hit: array<{_HIT}>>>"
_REPORT = f"struct<`BlastOutput_query-def`: string, Iteration: array<{_ROUND}>, BlastOutput_iterations: struct<Iteration: array<{_ROUND}>>>"


def _either(nested: Column, direct: Column) -> Column:
    """Elements inside their list's element, or side by side without one."""
    return F.coalesce(nested, direct)


def search_alignments(df: DataFrame, xml: str = "xml") -> DataFrame:
    """One row a query, hit and alignment of search reports (whole XML documents), read by Spark's XML parser: entities and CDATA are decoded.

    A hit without alignments has one row of nulls. Text that is no report gives no row.
    """
    report = F.from_xml(F.regexp_replace(xml, r"(?s)<!DOCTYPE[^>\[]*(\[.*?\])?[^>]*>", ""), _REPORT)
    rows = df.withColumn("_b", report)
    rows = rows.withColumn("_r", F.explode(_either(F.col("_b.BlastOutput_iterations.Iteration"), F.col("_b.Iteration"))))
    query = F.coalesce(F.col("_r.`Iteration_query-def`"), F.col("_b.`BlastOutput_query-def`"), F.lit(""))
    kept = [c for c in df.columns if c != xml]
    rows = rows.select(*kept, query.alias("query"), F.posexplode(_either(F.col("_r.Iteration_hits.Hit"), F.col("_r.Hit"))).alias("hit_no", "_h"))
    rows = rows.select(*kept, "query", (F.col("hit_no") + 1).alias("hit_no"), "_h", F.posexplode_outer(_either(F.col("_h.Hit_hsps.Hsp"), F.col("_h.Hsp"))).alias("_n", "_s"))
    part = lambda name: F.col(f"_s.`Hsp_{name}`")
    return rows.select(
        *kept, "query", "hit_no", (F.coalesce("_n", F.lit(0)) + 1).alias("alignment"), F.col("_h.Hit_accession").alias("accession"), F.col("_h.Hit_def").alias("title"),
        part("evalue").alias("e_value"), part("bit-score").alias("bit_score"), percent_identity(part("identity"), part("align-len")).alias("identity"),
        *[part(f"{side}-{end}").alias(f"{side}_{end}") for side in ("query", "hit") for end in ("from", "to")], part("qseq").alias("aligned_query"), part("hseq").alias("aligned_hit"),
    )


def search_hits(df: DataFrame, xml: str = "xml") -> DataFrame:
    """One row a query and hit: query, hit_no, accession, title, e-value, bit score and identity of the hit's first alignment; all are in ``search_alignments``."""
    kept = [c for c in df.columns if c != xml]
    return search_alignments(df, xml).where("alignment = 1").select(*kept, "query", "hit_no", "accession", "title", "e_value", "bit_score", "identity")


def annotation_of(text: Column) -> Column:
    """(id, protein, genes, ec) of a protein record whatever its shape: alone or the first of ``results``, with a recommended or a submitted name, genes as objects or as names. Null where the text is no JSON or has no accession."""
    get = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    whole = F.try_parse_json(text)
    record = F.coalesce(get(whole, "$.results[0]", "variant"), whole)

    def told(v: Column) -> Column:
        names = [get(v, f"$.proteinDescription.{p}") for p in ("recommendedName.fullName.value", "submissionNames[0].fullName.value", "alternativeNames[0].fullName.value")]
        genes = F.transform(get(v, "$.genes", "array<variant>"), lambda g: F.coalesce(get(g, "$.geneName.value"), get(g, "$.orfNames[0].value"), get(g, "$")))
        codes = F.coalesce(get(v, "$.proteinDescription.recommendedName.ecNumbers", "array<variant>"), get(v, "$.proteinDescription.submissionNames[0].ecNumbers", "array<variant>"))
        out = F.struct(get(v, "$.primaryAccession").alias("id"), F.coalesce(*names, get(v, "$.protein")).alias("protein"), genes.alias("genes"), F.transform(codes, lambda e: F.coalesce(get(e, "$.value"), get(e, "$"))).alias("ec"))
        return F.when(get(v, "$.primaryAccession").isNotNull(), out)

    return bind(record, told)


def job_ticket(text: Column) -> Column:
    """(request id, seconds to wait, status) of a submission or status page; nulls where absent."""
    part = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.struct(part(r"RID = (\S+)").alias("rid"), part(r"RTOE = (\d+)").cast("int").alias("wait"), part(r"Status=(\w+)").alias("status"))


_GENE = "struct<display_name: string, species: string, Transcript: array<struct<id: string, strand: int, Exon: array<struct<start: bigint, end: bigint>>>>>"


def gene_introns(df: DataFrame, json: str = "json") -> DataFrame:
    """(gene, species, transcript, strand, start, end) of the gaps between exons in coordinate order; transcripts of one exon give no row."""
    g = df.select(F.from_json(json, _GENE).alias("g")).select(F.col("g.display_name").alias("gene"), "g.species", F.explode("g.Transcript").alias("t"))
    exons = F.array_sort("t.Exon", lambda a, b: F.when(a.start < b.start, -1).when(a.start > b.start, 1).otherwise(0))
    g = g.select("gene", "species", F.col("t.id").alias("transcript"), F.when(F.col("t.strand") == 1, "+").otherwise("-").alias("strand"), exons.alias("e")).where("size(e) > 1")
    gaps = F.zip_with(F.slice("e", F.lit(1), F.size("e") - 1), F.slice("e", F.lit(2), F.size("e") - 1), lambda a, b: F.struct((a.end + 1).alias("start"), (b.start - 1).alias("end")))
    return g.select("gene", "species", "transcript", "strand", F.inline(gaps))


_LD_SCRIPT = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json\b[^>]*>(.*?)</script>"""


def json_blocks(html: Column) -> Column:
    """The JSON-LD texts of a page, whatever else their tags hold."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(_LD_SCRIPT), F.lit(1)), F.trim), lambda x: x.rlike(r"^\s*[\[{]"))


def embedded_code(html: Column, system: str) -> Column:
    """First code of a coding system in the page's JSON-LD blocks, or NA."""
    kind = "struct<code: array<struct<codingSystem: string, codeValue: string>>>"
    each = F.transform(json_blocks(html), lambda x: F.coalesce(F.from_json(x, kind).getField("code"), F.array().cast("array<struct<codingSystem: string, codeValue: string>>")))
    return F.coalesce(F.get(F.filter(F.flatten(each), lambda c: c.codingSystem == system), 0).codeValue, F.lit("NA"))


def page_title(html: Column, prefix: str = "") -> Column:
    return F.trim(F.replace(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1), F.lit(prefix), F.lit("")) if prefix else F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1))


def links(html: Column, pattern: str = '[^"]*') -> Column:
    return F.regexp_extract_all(html, F.lit(f'href="({pattern})"'), F.lit(1))


def _blocks(html: Column, tag: str, mark: str) -> Column:
    """Inner texts of the tags of a class, up to the next tag of it: blocks that stand side by side."""
    parts = F.split(html, rf"""(?i)<{tag}\b[^>]*\bclass\s*=\s*["'][^"'>]*\b{mark}\b[^>]*>""")
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def card_links(html: Column, mark: str = "drug-card", pattern: str = "/en/drug/substance/", base: str = "") -> Column:
    """The first link of each card that holds ``pattern``; cards without one give nothing."""
    found = F.transform(_blocks(html, "div", mark), lambda x: F.regexp_extract(x, rf"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"']*{pattern}[^"']*)["']""", 1))
    return F.transform(F.filter(found, lambda x: x != ""), lambda x: F.concat(F.lit(base), x))


def card_fields(html: Column, labels: dict[str, str], heading: str = "result-detail", column: str = "col-6", value: str = "fw-bold") -> Column:
    """Struct of ``name`` (the heading's h2) and, for each label, the marked value of the first paragraph that holds it; NA where absent."""
    or_na = lambda c: F.coalesce(F.nullif(F.trim(plain_text(c)), F.lit("")), F.lit("NA"))
    name = F.regexp_extract(F.get(_blocks(html, "div", heading), 0), r"(?is)<h2\b[^>]*>(.*?)</h2>", 1)
    lines = F.flatten(F.transform(_blocks(html, "div", column), lambda x: F.regexp_extract_all(x, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))))
    marked = rf"""(?is)<span\b[^>]*\bclass\s*=\s*["'][^"'>]*\b{value}\b[^>]*>(.*?)</span>"""
    pick = lambda label: F.regexp_extract(F.get(F.filter(lines, lambda x: F.contains(plain_text(x), F.lit(label))), 0), marked, 1)
    return F.struct(or_na(name).alias("name"), *[or_na(pick(label)).alias(field) for field, label in labels.items()])


def annotation(json: Column) -> Column:
    """The first result of a protein search response: id, genes, protein, ec numbers; null without results."""
    name = "struct<value: string>"
    kind = f"struct<results: array<struct<primaryAccession: string, genes: array<struct<geneName: {name}>>, proteinDescription: struct<recommendedName: struct<fullName: {name}, ecNumbers: array<{name}>>>>>>"
    first = F.get(F.from_json(json, kind).getField("results"), 0)
    best = first["proteinDescription"]["recommendedName"]
    out = F.struct(first["primaryAccession"].alias("id"), F.transform(first["genes"], lambda g: g["geneName"]["value"]).alias("genes"), best["fullName"]["value"].alias("protein"), F.transform(best["ecNumbers"], lambda e: e["value"]).alias("ec"))
    return F.when(first.isNotNull(), out)


def lines_after(text: Column, mark: str, n: int) -> Column:
    """Of the ``n`` lines behind the first line that holds ``mark``, those that are neither empty nor comments."""
    lines = F.split(text, r"\r?\n")
    at = F.get(F.filter(F.transform(lines, lambda x, i: F.when(F.contains(x, F.lit(mark)), i)), lambda i: i.isNotNull()), 0)
    following = F.when(at.isNotNull(), F.slice(lines, F.coalesce(at, F.lit(0)) + 2, F.lit(n))).otherwise(F.array().cast("array<string>"))
    return F.filter(following, lambda x: ~x.rlike("^(#.*)?$"))


def disease_rows(pages: DataFrame, estimates: DataFrame, drugs: DataFrame, prefix: str = "", system: str = "GARD") -> DataFrame:
    """Diseases with estimates and drugs.

    ``pages``: id, html (null where the page failed); ``estimates``: code, usa,
    world; ``drugs``: id, drug, synonyms, chemical. A page found without drugs
    gives no row; a failed page, or one without JSON-LD, gives one of NA.
    """
    html = F.col("html")
    found = F.coalesce(F.size(json_blocks(html)) > 0, F.lit(False))
    count = F.nullif(F.regexp_extract(html, r"orphan drug\(s\) \((\d+)\)", 1), F.lit(""))
    base = pages.select("id", found.alias("found"), embedded_code(html, system).alias("code"), page_title(html, prefix).alias("title"), count.alias("n"))
    full = base.where("found").join(estimates, "code", "left").join(drugs, "id")
    na = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NA"))
    rows = full.select("id", "code", truncated(F.col("title"), 50).alias("disease"), na("usa").alias("usa"), na("world").alias("world"), na("n").alias("n_drugs"), na("drug").alias("drug"), na("synonyms").alias("synonyms"), na("chemical").alias("chemical"))
    missing = base.where("NOT found").select("id", F.lit("NA").alias("code"), na("title").alias("disease"), *[F.lit("NA").alias(c) for c in ("usa", "world", "n_drugs", "drug", "synonyms", "chemical")])
    return rows.unionByName(missing)


def top_hits(hits: DataFrame, n: int = 5, key: str = "query") -> DataFrame:
    """The first ``n`` hits of each query, in the report's order."""
    return hits.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("hit_no"))).where(F.col("_r") <= n).drop("_r")


def poll(ask: Callable[[], str | None], tries: int = 20, first: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """Asks until there is an answer, waiting twice as long each time; None after ``tries``."""
    for k in range(tries):
        if (answer := ask()) is not None:
            return answer
        if k + 1 < tries:
            sleep(first * 2**k)
    return None


def _answers(size: int, send: Callable[[list[str]], str | None], kept: tuple[str, ...] = ()) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sends a partition's records (id, sequence) in batches of ``size`` as FASTA text; a failed batch gives the error, never another batch's answer. Of ``kept`` each batch has lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(rows: pd.DataFrame) -> pd.DataFrame:
            ids = rows["id"].astype(str).tolist()
            try:
                answer, error = send([f">{i}\n{s}" for i, s in zip(ids, rows["sequence"], strict=True)]), None
            except Exception as e:  # any failure of the transport belongs to this batch
                answer, error = None, f"{type(e).__name__}: {e}"
            return pd.DataFrame({**{c: [rows[c].tolist()] for c in kept}, "ids": [ids], "response": [answer], "error": [error]})

        held = None
        for batch in batches:
            held = batch if held is None or not len(held) else pd.concat([held, batch])
            while len(held) >= size:
                yield flush(held.iloc[:size])
                held = held.iloc[size:]
        if held is not None and len(held):
            yield flush(held)

    return run


def fetch(df: DataFrame, send: Callable[[list[str]], str | None], size: int = 50, id_col: str = "id", sequence: str = "sequence") -> DataFrame:
    """(ids, response, error): records of a partition go out in batches of ``size`` as FASTA text through ``send``.

    Batches form while a partition streams by; a failed batch gives its ids and the error, never another batch's answer.
    A lost executor sends its unfinished partition again, so ``send`` must bear repeats.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(sequence).alias("sequence"))
    return rows.mapInPandas(_answers(size, send), "ids array<string>, response string, error string")


_LEDGER = "keys array<struct<a: bigint, b: bigint>>, ids array<string>, response string, error string"


def fetch_resumable(df: DataFrame, send: Callable[[list[str]], str | None], ledger: str, size: int = 50, wave: int = 64, id_col: str = "id", sequence: str = "sequence") -> DataFrame:
    """(ids, response, error) of all batches in the folder ``ledger``, after those records of ``df`` were sent that have no answer there yet.

    Records are told by id and text, whatever batch they went out in: a second run sends only what is new, and what
    failed or got no answer. Batches go out in waves of ``wave``, each a committed write, so a run that dies loses the
    answers of one wave at most; a lost executor sends its unfinished batches of that wave again. Copies of a record are sent once.
    """
    spark = df.sparkSession
    known = spark.read.schema(_LEDGER).parquet(ledger) if _exists(spark, ledger) else spark.createDataFrame([], _LEDGER)
    answered = known.where("response IS NOT NULL").select(F.explode("keys").alias("key"))
    rows = df.select(record_key(id_col, sequence).alias("key"), F.col(id_col).cast("string").alias("id"), F.col(sequence).alias("sequence"))
    path = new_folder(spark, "pending")
    rows.dropDuplicates(["key"]).join(answered, "key", "left_anti").write.parquet(path)
    pending = spark.read.schema(rows.schema).parquet(path)
    waves = -(-pending.count() // (size * wave))
    for k in range(waves):
        some = pending.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == k)
        out = some.repartition(min(wave, spark.sparkContext.defaultParallelism)).mapInPandas(_answers(size, send, ("key",)), _LEDGER.replace("keys", "key", 1))
        out.withColumnRenamed("key", "keys").write.mode("append").parquet(ledger)
    done = spark.read.schema(_LEDGER).parquet(ledger) if waves or _exists(spark, ledger) else known
    return done.select("ids", "response", "error")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
