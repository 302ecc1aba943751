"""The pipeline's stages against brute force."""

from collections import defaultdict

import corpus_pipeline
from helixframe.llm import quality_rules
from tests.llm.test_operators import base_spans, corpus, jaccard_classes


def test_stages(spark, tmp_path):
    texts = [*corpus(9, 120), "clean words here and there " + " ".join(f"w{k}" for k in range(80)) + " password = hunter22 end"]
    df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    assert names == ["quality", "exact_duplicates", "near_duplicates", "secrets", "packing"]

    bits = {r.doc_id: r.fail_bits for r in quality_rules.ledger(quality_rules.measurements(docs)).collect()}
    good = stage["quality"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    kept = {r.doc_id: r.text for r in good.collect()}
    assert kept == {k: t for k, t in enumerate(texts) if not bits[k]} and len(texts) - 1 in kept

    distinct = stage["exact_duplicates"](spark, good, str(tmp_path))
    low = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    last = {low(t): k for k, t in sorted(kept.items())}
    assert {r.doc_id for r in distinct.collect()} == set(last.values())

    ids = sorted(last.values())
    classes = jaccard_classes([texts[k] for k in ids], 5, 80, 100)[1]
    single = stage["near_duplicates"](spark, distinct, str(tmp_path))
    left = {ids[c] for c in classes}
    assert {r.doc_id for r in single.collect()} == left and single.columns == docs.columns

    masked = stage["secrets"](spark, single, str(tmp_path))
    for r in masked.collect():
        assert ("[SECRET]" in r.text) == bool(base_spans(texts[r.doc_id])) and r.n_chars == len(r.text)

    total = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        total[r.doc_id] += r.length
        assert r.doc_tokens >= r.length
    assert set(total) == left


def test_odd_rows(spark, tmp_path):
    """Null ids, repeated rows, ids with two texts, null texts and clashing columns."""
    long = "some words that go on and on until there are enough of them for the rules to let the text pass " * 4
    varied = " ".join(f"word{k} and{k % 7}x" for k in range(60))
    rows = [(None, varied, "x"), (5, varied.upper(), "y"), (5, varied, "y"), (5, varied, "y"), (6, None, None), (7, "", "z"), (5, varied + " other", "y"), (None, varied, "x"), (8, long, "q")]
    docs = spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in rows], "doc_id long, text string, lang string, _sha string, n_chars long").withColumnRenamed("_sha", "source")
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, "")
    assert sorted(r.source for r in good.collect()) == ["x", "x", "y", "y", "y", "y"]
    got = sorted((r.doc_id, r.text) for r in stage["exact_duplicates"](spark, docs, "").collect() if r.text and r.doc_id == 5)
    assert got == [(5, varied.upper()), (5, varied + " other")]
    assert {r.doc_id for r in stage["exact_duplicates"](spark, docs, "").collect()} == {5, 7, 8}
    masked = stage["secrets"](spark, docs, "").collect()
    assert len(masked) == len(rows) and sum(r.text is None for r in masked) == 1
    assert stage["exact_duplicates"](spark, docs.limit(0), "").count() == 0 and stage["quality"](spark, docs.limit(0), "").count() == 0


def test_clashing_names_and_rows_of_one_id(spark):
    """Documents' own columns keep their values in every stage; near copies go by row."""
    words = [f"w{k}x" for k in range(90)]
    near = lambda k: " ".join([*words[:k], "edit", *words[k + 1 :]])
    other = " ".join(f"other{k} of{k}" for k in range(60))
    rows = [(0, " ".join(words)), (1, near(40)), (1, other), (None, near(50)), (None, "new " + other[:200]), (2, other), (2, other), (3, None), (3, ""), (3, "")]
    names = ["_sha", "_turn", "_kept", "n_words", "key", "set", "row", "_doc", "_rest", "id", "turn", "own", "fail_bits", "text_sha256"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), *[f"{c} {n}" for c in names]) for n, (k, t) in enumerate(rows)], schema)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        held = out.collect()
        assert held and all(r[c].startswith(f"{c} ") and r[c].split()[-1] == r["_sha"].split()[-1] for r in held for c in names)
        left = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in held)
        if name == "near_duplicates":
            assert left == sorted([(False, 0, " ".join(words)), (False, 1, other), (True, 0, "new " + other[:200]), (False, 3, ""), (False, 3, ""), (False, 3, "")])


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_tables_go(spark, tmp_path):
    from helixframe.llm import store

    store.release_all(spark)
    with store.temporary(spark) as keep:
        a, b = store.stash(spark.range(3), "a"), keep(store.stash(spark.range(4), "b"))
    assert b.count() == 4 and store._made[spark.sparkContext.applicationId] == [b._stashed_at]
    store.release_all(spark)
    assert not store._made[spark.sparkContext.applicationId] and a._stashed_at != b._stashed_at
