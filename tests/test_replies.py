"""Search reports and annotations of several shapes."""

from collections import Counter

import pytest

from helixframe.sources import responses

REPORT = """<?xml version="1.0"?>
<!DOCTYPE BlastOutput PUBLIC "-//x" "y.dtd">
<BlastOutput><BlastOutput_query-def>all &lt;of&gt; it</BlastOutput_query-def><BlastOutput_iterations>
<Iteration><Iteration_hits>
<Hit><Hit_id>i</Hit_id><Hit_def>A &amp; B &gt;C [x]</Hit_def><Hit_accession>X1</Hit_accession><Hit_hsps>
<Hsp><Hsp_bit-score>7.5</Hsp_bit-score><Hsp_evalue>1e-9</Hsp_evalue><Hsp_identity>9</Hsp_identity><Hsp_align-len>12</Hsp_align-len><Hsp_qseq>AC-G</Hsp_qseq></Hsp>
<Hsp><Hsp_evalue>0.5</Hsp_evalue></Hsp></Hit_hsps></Hit>
<Hit><Hit_def><![CDATA[<i>& more]]></Hit_def><Hit_accession>X2</Hit_accession></Hit>
</Iteration_hits></Iteration>
<Iteration><Iteration_query-def>second</Iteration_query-def><Iteration_hits></Iteration_hits></Iteration>
</BlastOutput_iterations></BlastOutput>"""


def test_alignments_of_a_report(spark):
    df = spark.createDataFrame([(1, REPORT), (2, "no report <"), (3, None), (4, "")], "k int, xml string")
    got = responses.search_alignments(df).orderBy("hit_no", "alignment").collect()
    assert [(r.k, r.query, r.hit_no, r.alignment, r.accession, r.title, r.e_value, r.identity, r.aligned_query) for r in got] == [
        (1, "all <of> it", 1, 1, "X1", "A & B >C [x]", 1e-9, 75.0, "AC-G"),
        (1, "all <of> it", 1, 2, "X1", "A & B >C [x]", 0.5, None, None),
        (1, "all <of> it", 2, 1, "X2", "<i>& more", None, None, None),
    ]
    assert [(r.hit_no, r.bit_score) for r in responses.search_hits(df).orderBy("hit_no").collect()] == [(1, 7.5), (2, None)]


def test_annotations_of_any_shape(spark):
    replies = [
        '{"results": [{"primaryAccession": "P1", "proteinDescription": {"recommendedName": {"fullName": {"value": "x"}, "ecNumbers": [{"value": "1.1"}]}}, "genes": [{"geneName": {"value": "g"}}]}]}',
        '{"primaryAccession": "P2", "proteinDescription": {"submissionNames": [{"fullName": {"value": "y"}}]}, "genes": ["a", "b"]}',
        '{"primaryAccession": "P3"}', '{"results": []}', "[1, 2]", "<html>", "", None,
    ]
    df = spark.createDataFrame(list(enumerate(replies)), "k int, t string")
    got = df.select("k", responses.annotation_of(df.t).alias("a")).orderBy("k").collect()
    assert [tuple(r.a) if r.a else None for r in got] == [("P1", "x", ["g"], ["1.1"]), ("P2", "y", ["a", "b"], None), ("P3", None, None, None), *[None] * 5]


def _sender(log, fail="", die=""):
    def send(records):
        import os
        import uuid

        text = "\n".join(records)
        if die and die in text:
            os._exit(1)  # the worker is gone, and the job with it
        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(r.split("\n")[0] for r in records))
        if fail and fail in text:
            raise OSError("refused")
        return f"{len(records)} seen"

    return send


def _sent(log):
    out = Counter()
    for p in log.iterdir():
        out.update(p.read_text().split("\n"))
        p.unlink()
    return out


def test_a_run_goes_on_where_one_died(spark, tmp_path):
    log, ledger = tmp_path / "log", str(tmp_path / "ledger")
    log.mkdir()
    rows = [(k, f"ACGT{k}") for k in range(40)] + [(3, "ACGT3"), (3, "other"), (None, "ACGT")]
    df = spark.createDataFrame(rows, "id int, sequence string")
    with pytest.raises(Exception):  # noqa: B017 (Spark's own, of the lost worker)
        responses.fetch_resumable(df, _sender(log, die="ACGT17"), ledger, size=3, wave=2)
    answered = {i for r in spark.read.schema(responses._LEDGER).parquet(ledger).collect() for i in r.ids} if responses._exists(spark, ledger) else set()
    _sent(log)
    got = responses.fetch_resumable(df, _sender(log, fail="ACGT21"), ledger, size=3, wave=2).collect()
    second = _sent(log)
    assert max(second.values()) <= 2 and second[">3"] <= 2 and not {f">{i}" for i in answered if i != "3"} & set(second)
    failed = {i for r in got if r.error for i in r.ids}
    assert "21" in failed and all(r.error == "OSError: refused" for r in got if r.response is None)
    got = responses.fetch_resumable(df, _sender(log), ledger, size=3, wave=2).collect()
    assert set(_sent(log)) == {f">{i}" for i in failed}
    assert Counter(i for r in got if r.response for i in r.ids) == Counter([str(k) for k in range(40)] + ["3", "None"])
    responses.fetch_resumable(df, _sender(log), ledger, size=3, wave=2)
    assert not _sent(log)


def test_batches_of_a_partition(spark, tmp_path):
    df = spark.createDataFrame([(k, "AC") for k in range(7)], "id int, sequence string").coalesce(1)
    got = responses.fetch(df, _sender(tmp_path), size=3).collect()
    assert [(r.ids, r.response) for r in got] == [(["0", "1", "2"], "3 seen"), (["3", "4", "5"], "3 seen"), (["6"], "1 seen")]
