"""Parsers on hand-made files, recorded responses, FASTQ ranges."""

import struct

import pytest
from pyspark.sql import functions as F

from helixframe.sources import fasta, flatfiles, responses
from helixframe.sources.fastq_source import FastqSource

GENBANK = """LOCUS       pTest   24 bp    DNA     circular SYN 05-MAR-2020
DEFINITION  A test
            plasmid.
ACCESSION   X1
REFERENCE   1  (bases 1 to 24)
  AUTHORS   Doe,J.
  TITLE     A title
            goes on
FEATURES             Location/Qualifiers
     CDS             complement(join(3..8,
                     12..17))
                     /gene="abc"
                     /note="first ""quoted""
                     CDS 1..2 line"
                     /pseudo
     misc_feature    20
                     /label=mark
ORIGIN
        1 acgtacgtac gtacgtacgt acgt
//
LOCUS       broken line
ORIGIN
        1 ac
//
"""


def test_genbank(spark, tmp_path):
    (tmp_path / "a.gb").write_text(GENBANK)
    a, b = sorted(flatfiles.read_genbank(spark, str(tmp_path / "a.gb")).collect(), key=lambda r: r.error or "")
    assert (a["name"], a["size"], a.circular, a.division, str(a.date), a.definition) == ("pTest", 24, True, "SYN", "2020-03-05", "A test plasmid.")
    assert a.sequence == "acgt" * 6 and a.references == [{"description": "1  (bases 1 to 24)", "authors": "Doe,J.", "title": "A title goes on"}]
    cds, mark = a.features
    assert (cds["name"], cds.start, cds.end, cds.strand, cds.qualifiers["note"], cds.qualifiers["pseudo"]) == ("abc", 3, 17, "-", ['first "quoted" CDS 1..2 line'], [""])
    assert (mark["name"], mark.start, mark.end, mark.strand) == ("mark", 20, 20, "+")
    assert (b.error, b.sequence) == ("LOCUS", "ac")


def block(tag, data):
    return struct.pack(">BI", tag, len(data)) + data


def test_snapgene(spark, tmp_path):
    xml = b'<Features><Feature name="f" type="CDS" directionality="2"><Segment range="2-4" color="#fff"/><Q name="note"><V text="a &lt;b&gt;"/></Q></Feature></Features>'
    data = b"\t" + struct.pack(">I", 14) + b"SnapGene" + struct.pack(">HHH", 1, 2, 3) + block(0, b"\x03AACGT") + block(7, b"zz") + block(6, b"<Notes><Type>Syn</Type></Notes>") + block(10, xml)
    (tmp_path / "a.dna").write_bytes(data)
    (tmp_path / "b.dna").write_bytes(b"nothing")
    (tmp_path / "c.dna").write_bytes(data[:-5])
    rows = flatfiles.read_snapgene(spark, str(tmp_path))
    got = {r.file[-5]: r for r in rows.collect()}
    a = got["a"]
    assert (a.sequence, a.topology, a.strandedness, a.dam_methylated, a.notes) == ("AACGT", "circular", "double", False, {"Type": "Syn"})
    assert (a.features[0].strand, a.features[0].qualifiers["note"]) == ("-", ["a <b>", "color: #fff"])
    assert got["b"].error == "not a SnapGene file" and got["c"].error == "cut short"
    assert [(r.id, r.sequence) for r in flatfiles.feature_records(rows.where("error IS NULL")).collect()] == [("CDS|f|-|2..4", "CGT")]


def test_broken_features():
    xml = b'<Features><Feature name="f" type="CDS"><Segment range="2-4"/><Segment range="7-x"/><Q name="n"><V>a<b>c</b></V><V int="3"/></Q></Feature></Features>'
    head = b"\t" + struct.pack(">I", 14) + b"SnapGene" + struct.pack(">HHH", 1, 2, 3)
    f = flatfiles.parse_snapgene(head + block(10, xml))["features"][0]
    assert (f["start"], f["end"], f["strand"], f["location"], f["qualifiers"]) == (2, 4, ".", "2..4", {"n": ["ac", "3"], "label": ["f"]})
    assert flatfiles.parse_snapgene(head + block(10, xml[:-9]))["error"] == "features"


def test_trace(spark, tmp_path):
    body = [(b"PBAS", 2, 2, b"ACGTA"), (b"PCON", 2, 2, bytes([9, 8, 7, 6, 5])), (b"FWO_", 1, 2, b"GATC"), (b"SMPL", 1, 18, b"\x02s1"), (b"DATA", 9, 4, struct.pack(">3h", 1, 5, 10)), (b"DATA", 10, 4, struct.pack(">3h", 2, 20, 3))]
    data, entries = b"", b""
    for name, number, kind, raw in body:
        at = 34 + len(data)
        size = {4: 2}.get(kind, 1)
        tail = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">i", at)
        data += raw if len(raw) > 4 else b""
        entries += struct.pack(">4sihhii", name, number, kind, size, len(raw) // size, len(raw)) + tail + b"\0" * 4
    head = b"ABIF" + struct.pack(">h4sihhiii", 101, b"tdir", 1, 1023, 28, len(body), len(entries), 34 + len(data))
    (tmp_path / "x.ab1").write_bytes(head.ljust(34, b"\0") + data + entries)
    rows = flatfiles.read_traces(spark, str(tmp_path))
    r = rows.withColumn("t", flatfiles.trace_threshold(F.col("channels"))).first()
    assert (r["sample"], r.bases, r.quality, r.channels, r.t) == ("s1", "ACGTA", [9, 8, 7, 6, 5], {"G": [1, 5, 10], "A": [2, 20, 3]}, 14.0)
    assert flatfiles.parse_trace(b"zz")["error"]


def test_functions(spark, tmp_path):
    (tmp_path / "a.py").write_text("import os\ndef f(a, b) -> int:\n    return os.getpid() + json.x()\nimport json\n")
    (tmp_path / "b.py").write_text("def (")
    got = {r.file[-4]: r for r in flatfiles.read_functions(spark, str(tmp_path)).collect()}
    assert (got["a"].function, got["a"].args, got["a"].returns, got["a"].dependencies) == ("f", "a, b", "int", "json, os") and got["b"].error == "SyntaxError"
    nested = "import a.b as c\ndef f(x, *, y):\n    from m.n import g\n    def h():\n        import os\n        return g(c.d.e())\n    os.x()\n    return h\nasync def k() -> list[int]:\n    return g()\n"
    assert [(r["function"], r["args"], r["returns"], r["dependencies"]) for r in flatfiles.parse_functions(nested)] == [("f", "x, y", "None", "a, m"), ("h", "", "None", "a, m"), ("k", "", "list[int]", "")]


def test_responses(spark):
    hit = "<Hit><Hit_def>t{0}</Hit_def><Hit_accession>A{0}</Hit_accession><Hsp><Hsp_evalue>1e-5</Hsp_evalue><Hsp_identity>9</Hsp_identity><Hsp_align-len>10</Hsp_align-len></Hsp><Hsp><Hsp_evalue>3</Hsp_evalue></Hsp></Hit>"
    xml = "<BlastOutput><BlastOutput_query-def>q0</BlastOutput_query-def><Iteration><Iteration_query-def>q1</Iteration_query-def>" + "".join(hit.format(k) for k in range(7)) + "</Iteration><Iteration>" + hit.format(9) + "</Iteration></BlastOutput>"
    hits = responses.search_hits(spark.createDataFrame([(xml,)], "xml string"))
    assert {(r.query, r.accession, r.e_value, r.identity) for r in responses.top_hits(hits).collect()} == {("q1", f"A{k}", 1e-5, 90.0) for k in range(5)} | {("q0", "A9", 1e-5, 90.0)}
    t = spark.range(1).select(responses.job_ticket(F.lit("RID = X1\nRTOE = 12\nStatus=READY")).alias("t")).first().t
    assert (t.rid, t.wait, t.status) == ("X1", 12, "READY")
    gene = '{"display_name":"g","species":"s","Transcript":[{"id":"t","strand":-1,"Exon":[{"start":21,"end":30},{"start":1,"end":10}]},{"id":"u","strand":1,"Exon":[{"start":1,"end":2}]}]}'
    assert [tuple(r) for r in responses.gene_introns(spark.createDataFrame([(gene,)], "json string")).collect()] == [("g", "s", "t", "-", 11, 20)]


def test_diseases(spark):
    page = '<title>Net: Rare</title><a href="/d">x</a> orphan drug(s) (2)<script type="application/ld+json"> {"code":[{"codingSystem":"X","codeValue":"0"},{"codingSystem":"GARD","codeValue":"7"}]} </script>'
    pages = spark.createDataFrame([(1, page), (2, None), (3, page), (4, "<title>Net: Plain</title>")], "id int, html string")
    estimates = spark.createDataFrame([("7", "10", None)], "code string, usa string, world string")
    drugs = spark.createDataFrame([(1, "d", "s", None)], "id int, drug string, synonyms string, chemical string")
    got = {r.id: tuple(r)[1:] for r in responses.disease_rows(pages, estimates, drugs, "Net: ").collect()}
    assert got == {1: ("7", "Rare", "10", "NA", "2", "d", "s", "NA"), 2: ("NA",) * 8, 4: ("NA", "Plain", *["NA"] * 6)}
    assert pages.select(responses.links(F.col("html")).alias("l")).first().l == ["/d"]


def test_pages(spark):
    one = lambda c, html: spark.createDataFrame([(html,)], "html string").select(c.alias("x")).first().x
    html = F.col("html")
    page = "<SCRIPT id='a' type='application/ld+json' nonce=x>{\"code\":[]}</SCRIPT><script type=\"application/ld+json\">[1]</script><script type=application/ld+json>\n {\"code\":[{\"codingSystem\":\"G\",\"codeValue\":\"7\"}]}</script>"
    assert len(one(responses.json_blocks(html), page)) == 3 and one(responses.embedded_code(html, "G"), page) == "7"
    assert one(responses.embedded_code(html, "G"), None) == "NA" == one(responses.embedded_code(html, "G"), "<p>")
    cards = '<div class="x drug-card y"><a href="/o">o</a><a class="z" href="/en/drug/substance/1?q">d</a></div><div class="drug-card"><b>none</b></div><div class="drug-card"><a href="/en/drug/substance/2">e</a></div>'
    assert one(responses.card_links(html, base="https://h"), cards) == ["https://h/en/drug/substance/1?q", "https://h/en/drug/substance/2"]
    detail = '<div class="result-detail"><h2> A &amp; B </h2></div><div class="col-6"><p>Code/Synonyms: <span class="fw-bold">s1</span></p></div><div class="col-6"><p>Other: <span class="fw-bold">no</span></p></div>'
    assert tuple(one(responses.card_fields(html, {"synonyms": "Code/Synonyms:", "chemical": "Chemical name or description:"}), detail)) == ("A & B", "s1", "NA")
    assert one(responses.lines_after(html, "QueryID", 3), "x\nQueryID a\n# c\nr1\n\nr2") == ["r1"] and one(responses.lines_after(html, "QueryID", 3), "x") == []
    answer = '{"results":[{"primaryAccession":"P1","genes":[{"geneName":{"value":"g"}}],"proteinDescription":{"recommendedName":{"fullName":{"value":"p"},"ecNumbers":[{"value":"1.1"}]}}},{"primaryAccession":"P2"}]}'
    assert tuple(one(responses.annotation(html), answer)) == ("P1", ["g"], "p", ["1.1"]) and one(responses.annotation(html), '{"results":[]}') is None


def test_fetch(spark):
    def send(records):
        if any("bad" in r for r in records):
            raise ValueError("no")
        return f"{len(records)} ok"

    df = spark.createDataFrame([(str(k), "bad" if k == 6 else "AC") for k in range(7)], "id string, sequence string").coalesce(1)
    assert [(len(r.ids), r.response, r.error) for r in responses.fetch(df, send, 3).collect()] == [(3, "3 ok", None), (3, "3 ok", None), (1, None, "ValueError: no")]
    answers, waits = iter([None, None, "x"]), []
    assert responses.poll(lambda: next(answers), sleep=waits.append) == "x" and waits == [3.0, 6.0]
    assert responses.poll(lambda: None, 2, 1.0, waits.append) is None


@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
def test_fastq_ranges(spark, tmp_path, size):
    records = [(f"r{k} x", "ACGTN"[: k % 5 + 1], "@+@II"[: k % 5 + 1]) for k in range(40)]
    (tmp_path / "a.fastq").write_text("".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in records))
    spark.dataSource.register(FastqSource)
    if size == 1:
        size = 3  # many ranges hold no record
    rows = spark.read.format("fastq").option("rangeBytes", size).load(str(tmp_path / "a.fastq")).collect()
    assert [(r.id, r.sequence, r.quality) for r in sorted(rows, key=lambda r: r.start)] == records and all(r.valid for r in rows)


def test_readers(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">p\nMKV\n>q\nmkv\n>r\nM\n")
    (tmp_path / "b.fastq").write_text("@f\nACG\n+\n>>>\n")
    got = {(r.id, r.sequence, r.quality) for r in fasta.read_sequences(spark, str(tmp_path)).collect()}
    assert got == {("p", "MKV", None), ("q", "MKV", None), ("r", "M", None), ("f", "ACG", ">>>")}
    assert [r.id for r in fasta.read_dedup(spark, str(tmp_path / "a.fasta")).collect()] == ["r", "p"]
    assert fasta.read_proteins(spark, str(tmp_path / "a.fasta")).count() == 3
    (tmp_path / "c.fasta").write_text(">p\nMB\n")
    with pytest.raises(Exception, match="not a protein"):
        fasta.read_proteins(spark, str(tmp_path / "c.fasta")).collect()
