"""Registered queries of dynamic programs; their SQL fills the same matrices row by row in recursive queries.

An alignment or structure itself is held by ``sound``: it spells its inputs and
is worth its score, which the SQL finds best.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import alignment, gapped, search
from helixframe.plans.registry import HEX, PLAIN, _dna, _dna_sql, _neighbours, _RC, _register, _table

_PAIRS = f"SELECT a.id, a.sequence AS x, b.sequence AS y FROM ({_dna_sql()}) a JOIN ({_dna_sql()}) b ON b.id = a.id + 1"


def _matrix(pairs: str, match: int, mismatch: int, gap: int, floor: int | None = None, local: bool = False, free: bool = False, n: int = 32, keys: str = "id") -> str:
    """SQL of (keys, score) for ``pairs`` (keys, x, y) of ``n`` letters each."""
    low = mismatch if floor is None else max(mismatch, floor)
    edge = "0" if local or free else f"{gap} * j"
    left = "0" if local or free else f"{gap} * (i + 1)"
    up = f"r.row[j] + CASE WHEN j = {n + 1} THEN 0 ELSE {gap} END" if free else f"r.row[j] + {gap}"
    cell = f"CASE WHEN j = 1 THEN {left} ELSE greatest(r.row[j - 1] + CASE WHEN substr(x, i + 1, 1) = substr(y, (j - 1)::INT, 1) THEN {match} ELSE {low} END, {up}{', 0' if local else ''}) END"
    along = f"CASE WHEN i = {n - 1} THEN 0 ELSE {gap} END" if free else str(gap)
    return f"""WITH RECURSIVE p AS ({pairs}),
r AS (SELECT p.*, 0 AS i, list_transform(range(0, {n + 1}), lambda j: ({edge})::BIGINT) AS row, 0::BIGINT AS best FROM p
    UNION ALL SELECT {keys}, x, y, i + 1, full_row, greatest(best, list_max(full_row)) FROM (
        SELECT *, list_transform(range(1, {n + 2}), lambda j: list_max(list_transform(range(1, j + 1), lambda k: u[k] + ({along}) * (j - k)))) AS full_row FROM (
            SELECT {keys}, x, y, i, best, list_transform(range(1, {n + 2}), lambda j: ({cell})::BIGINT) AS u FROM r WHERE i < {n})))
SELECT {keys}, {'best' if local else f'row[{n + 1}]'}::BIGINT AS score, true AS sound FROM r WHERE i = {n}"""


def _scored(rows: DataFrame, scheme: gapped.Scheme, whole: bool = True) -> F.Column:
    return gapped.sound(F.col("seq1"), F.col("seq2"), whole) & (gapped.rescored(F.col("aligned1"), F.col("aligned2"), scheme) == F.col("score"))


@_register(_matrix(_PAIRS, 2, -1, -2))
def global_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring keys aligned."""
    rows = alignment.align(_neighbours(spark, sf_dir))
    return rows.select("id", "score", _scored(rows, gapped.Scheme()).alias("sound"))


@_register(_matrix(_PAIRS, 2, -1, -2, local=True))
def local_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.align(_neighbours(spark, sf_dir), local=True)
    return rows.select("id", "score", _scored(rows, gapped.Scheme(), whole=False).alias("sound"))


@_register(_matrix(_PAIRS, 2, -1, -2, local=True))
def counted_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local alignments with their counts and ranges; of equal options the last counts."""
    rows = gapped.align_with(_neighbours(spark, sf_dir), gapped.COUNTED)
    counts = (F.col("n_match") * 2 - F.col("n_mismatch") - F.col("n_gap") * 2 == F.col("score")) & (F.col("end1") - F.col("start1") + 1 == F.length(F.replace("aligned1", F.lit("-"), F.lit(""))))
    return rows.select("id", "score", (_scored(rows, gapped.COUNTED, whole=False) & counts).alias("sound"))


@_register(_matrix(_PAIRS, 2, -1, -2, free=True))
def free_end_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gapped.align_with(_neighbours(spark, sf_dir), gapped.FREE_ENDS)
    return rows.select("id", "score", gapped.sound(F.col("seq1"), F.col("seq2")).alias("sound"))


@_register()
def merged_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which common stretch counts hangs on the order of equal options, which SQL has none of; tests hold it against examples."""
    return gapped.merge_reads(_neighbours(spark, sf_dir))


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of four neighbouring suppliers."""
    return _dna(spark, sf_dir, "supplier", "s_suppkey").withColumn("family", F.floor(F.col("id") / 4))


@_register(f"SELECT id // 4 AS family, id, true AS sound FROM ({_dna_sql('supplier', 's_suppkey')})")
def aligned_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member spells its sequence, and all of a family are equally long."""
    rows = gapped.align_families(_families(spark, sf_dir), "family").join(_dna(spark, sf_dir, "supplier", "s_suppkey"), "id")
    from pyspark.sql import Window

    family = Window.partitionBy("family")
    even = F.min(F.length("aligned")).over(family) == F.max(F.length("aligned")).over(family)
    return rows.select("family", "id", ((F.replace("aligned", F.lit("-"), F.lit("")) == F.col("sequence")) & even).alias("sound"))


_FAMILY_PAIRS = f"SELECT a.id // 4 AS family, a.id AS id1, b.id AS id2, a.sequence AS x, b.sequence AS y FROM ({_dna_sql('supplier', 's_suppkey')}) a JOIN ({_dna_sql('supplier', 's_suppkey')}) b ON a.id // 4 = b.id // 4 AND a.id < b.id"


@_register(f"SELECT family, id1, id2, score, -score AS distance FROM ({_matrix(_FAMILY_PAIRS, 3, -2, -3, keys='family, id1, id2')})")
def pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gapped.pair_scores(_families(spark, sf_dir), "family")


def _folds(texts: str, keys: str) -> str:
    """SQL of (keys, pairs, sound) for ``texts`` (keys, s) of 32 letters: rows of the matrix from the last letter up."""
    cell = """list_transform(range(1, 33), lambda j: CASE WHEN j <= i - 1 THEN 0 ELSE greatest(t[1][j], coalesce(list_max(list_transform(
        list_filter(range(i, j + 1), lambda k: substr(s, (i - 1)::INT, 1) || substr(s, k::INT, 1) IN ('AT', 'TA', 'GC', 'CG')),
        lambda k: 1 + CASE WHEN k > i THEN t[1][k - 1] ELSE 0 END + CASE WHEN k < j THEN t[k + 2 - i][j] ELSE 0 END)), 0)) END)"""
    return f"""WITH RECURSIVE r AS (SELECT {keys}, s, 32::BIGINT AS i, [list_transform(range(0, 32), lambda j: 0::BIGINT)] AS t FROM ({texts})
    UNION ALL SELECT {keys}, s, i - 1, list_prepend({cell}, t) FROM r WHERE i > 1)
SELECT {keys}, t[1][32]::BIGINT AS pairs, true AS sound FROM r WHERE i = 1"""


def _balanced(sequence: str) -> F.Column:
    """As long as its sequence, with as many opened as closed pairs as counted."""
    count = lambda c: F.length("structure") - F.length(F.replace("structure", F.lit(c), F.lit("")))
    return (F.length("structure") == F.length(sequence)) & (count("(") == F.col("pairs")) & (count(")") == F.col("pairs"))


@_register(_folds(f"SELECT id, sequence AS s FROM ({_dna_sql()})", "id"))
def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.fold(_dna(spark, sf_dir)).select("id", "pairs", _balanced("sequence").alias("sound"))


@_register(_folds(f"SELECT id, 'FW' AS direction, sequence AS s FROM ({_dna_sql()}) UNION ALL SELECT id, 'RV', {_RC.format('sequence')} FROM ({_dna_sql()})", "id, direction"))
def folded_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gapped.fold_strands(_dna(spark, sf_dir)).select("id", "direction", "pairs", _balanced("transcript").alias("sound"))


@_register(f"""WITH RECURSIVE d AS (SELECT p_brand, p_partkey AS id, translate(substr(md5(p_partkey::VARCHAR), 1, (p_partkey % 9 + 4)::INT), '{HEX}', '{PLAIN}') AS sequence FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(sequence) DESC, id) AS n, min(length(sequence)) OVER (PARTITION BY p_brand) AS k FROM d),
w AS (SELECT p_brand, id, sequence, n, list_transform(range(1, (length(sequence) - k + 2)::BIGINT), lambda i: substr(sequence, i::INT, k::INT)) AS w FROM k),
r AS (SELECT p_brand, id, sequence, n, w AS seen, true AS kept FROM w WHERE n = 1
    UNION ALL SELECT w.p_brand, w.id, w.sequence, w.n, list_distinct(list_concat(seen, w.w)), NOT list_has_all(seen, w.w) FROM r JOIN w ON w.p_brand = r.p_brand AND w.n = r.n + 1)
SELECT p_brand, id, sequence FROM r WHERE kept""")
def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy by length within a brand."""
    key = F.col("p_partkey")
    cut = F.substring(F.md5(key.cast("string")), F.lit(1), (key % 9 + 4).cast("int"))
    return search.cover_dedup(_table(spark, sf_dir, "part").select("p_brand", key.alias("id"), F.translate(cut, HEX, PLAIN).alias("sequence")), "p_brand")
