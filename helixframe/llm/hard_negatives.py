"""Hard negatives by norm-bucketed search over integer vectors; exact.

An anchor's positives are its first rows of the same label by inner product; a
negative of (anchor, positive) is one of another label whose score lies between
two shares of the positive's score. Both are searches of windows: an anchor, a
lowest and a highest score, and how many rows are wanted.

Candidates are sorted by norm and cut into buckets of about a megabyte; anchors
into blocks, those with like needs together. By Cauchy-Schwarz a score is at
most the product of the norms, so a window needs buckets whose largest norm is
its limit over its anchor's norm at least. The limit is the window's lowest
score or the worst of the rows it has already, if it has as many as it wants.
The buckets with the largest norms are searched first, over all windows; what
they found bounds the rest, of which strips of anchors then leave out buckets,
and within a cell each bucket is held against every window's running limit.

A cell is a strip of anchor blocks with a slot of buckets: both sides are sent
to the cells they belong to, so a task holds a few megabytes whatever the size
of the table, label or group of copies. Every window meets every bucket its
limits allow; none is capped or sampled.

Rows with a null id, label or vector, or with a null component, take no part.
Missing components of shorter vectors count as zero. Ties go to the smaller id.
Repeated ids are rows of their own: each is an anchor or candidate for itself.
Scores beyond 2^50 raise an error. An empty table, or one without anchors, gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from helixframe.llm.store import release, small_batches, stash
from helixframe.llm.vectors import array_of, bytes_of, matrix, numbered, squares

#: Bytes of a bucket's matrix, and rows at most; anchors of a block; buckets and blocks of a cell.
BUCKET_BYTES, BUCKET_ROWS, BLOCK, SLOT, STRIP = 1 << 20, 2048, 128, 16, 64
#: Matrices of a range of the sorted table, about.
RUN = 8
#: Share of the rows, those with the largest norms, that is searched first.
FIRST = 1 / 16
_NONE = -(1 << 62)
_SLACK = 1 - 1e-9


@dataclass(frozen=True)
class Spec:
    """Positives of an anchor, negatives of a pair, and the negatives' scores in parts of the positive's: low to high ``per`` of it."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    per: int = 100


def prepared(df: DataFrame, anchor: Column, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, vector, anchor, norm and _row of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<long>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    kept = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(F.exists("vector", lambda x: x.isNull()), F.lit(True)))
    return stash(numbered(kept.withColumn("norm", F.sqrt(squares(F.col("vector"))))), "negatives-rows")


def _parts(n: int, per: int) -> int:
    return max(1, -(-n // (RUN * per)))


def packed(rows: DataFrame, n: int, order: list[Column], per: int, width: int, windows: bool) -> DataFrame:
    """The ``n`` rows of a table, sorted, as matrices of ``per`` rows: (part, norm: the largest, need, ids, labels, rows, norms, vectors; with ``windows`` owner, slot, low, high, floor of each)."""
    parts = _parts(n, per)
    names = ["part", "norm", "need", "ids", "labels", "rows", "norms", "vectors"] + (["owner", "slot", "low", "high", "floor"] if windows else [])

    def run(batches):
        part, held, room = TaskContext.get().partitionId() << 32, [], per

        def flush():
            nonlocal part, room
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids, labels, number, norms = (whole.column(c).to_numpy() for c in ("id", "label", "_row", "norm"))
            vectors = matrix(whole.column("vector").combine_chunks(), width, "<i4")
            columns = [norms.max(), float(whole.column("need").to_numpy().min()) if windows else 0.0]
            order = np.lexsort((number, ids))  # places in a bucket rank ties
            binary = [ids[order], labels[order], number[order], norms[order], vectors[order]]
            if windows:
                back = np.argsort(order)
                lists = whole.column("windows").combine_chunks()
                owner = np.repeat(back, np.diff(np.asarray(lists.offsets)))
                flat = lists.flatten()
                binary += [owner.astype(np.int64), *[flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("slot", "low", "high", "floor")]]
            part, room = part + 1, per
            return pa.RecordBatch.from_arrays([pa.array([part - 1], pa.int64()), *[pa.array([c], pa.float64()) for c in columns], *map(bytes_of, binary)], names)

        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                held.append(batch.slice(lo, room))
                room -= held[-1].num_rows
                lo += held[-1].num_rows
                if not room:
                    yield flush()
        if held:
            yield flush()

    columns = ["id", "label", "_row", "norm", "vector"] + (["need", "windows"] if windows else [])
    schema = "part long, norm double, need double, " + ", ".join(f"{c} binary" for c in names[3:])
    return rows.select(columns).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema)


class Found:
    """The best rows of each window so far: scores and ids, best first; ``_NONE`` where there are fewer."""

    def __init__(self, windows: int, wanted: int):
        self.score = np.full((windows, wanted), _NONE, np.int64)
        self.id = np.zeros((windows, wanted), np.int64)
        self.row = np.zeros((windows, wanted), np.int64)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Merge as many rows for each of the windows ``at``."""
        score, ids, rows = (np.concatenate((x[at], y), 1) for x, y in ((self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, -score))[:, : self.score.shape[1]]
        for mine, new in ((self.score, score), (self.id, ids), (self.row, rows)):
            mine[at] = np.take_along_axis(new, order, 1)


def searched(blocks: list[dict], buckets: list[dict], wanted: int, same: bool) -> list[tuple]:
    """(anchor row, slot, score, id, row) of the best rows that a cell's buckets have for its windows."""
    out = []
    for a in blocks:
        found = Found(len(a["owner"]), wanted)
        norm = a["norms"][a["owner"]]
        left = a["vectors"].astype(np.float64)
        for c in buckets:
            limit = np.maximum(np.maximum(a["low"], a["floor"]), found.score[:, -1])
            open_ = np.flatnonzero(limit * _SLACK <= norm * c["norm"])
            if not len(open_):
                continue
            scores = np.rint(left @ c["vectors"].T.astype(np.float64)).astype(np.int64)  # exact: all sums stay below 2^53
            alike = a["labels"][:, None] == c["labels"]
            scores[(~alike | (a["rows"][:, None] == c["rows"])) if same else alike] = _NONE
            own = scores[a["owner"][open_]]
            own[(own < limit[open_, None]) | (own > a["high"][open_, None])] = _NONE
            some = np.flatnonzero((own != _NONE).any(1))
            if not len(some):
                continue
            own, n = own[some], own.shape[1]
            # one number for score and place, as ids rise with places; a row that isn't allowed stays below all others
            key = np.where(own == _NONE, _NONE, own * n + (n - 1 - np.arange(n)))
            best = np.argpartition(key, n - wanted, 1)[:, n - wanted :] if n > wanted else np.broadcast_to(np.arange(n), key.shape)
            found.add(open_[some], np.take_along_axis(own, best, 1), c["ids"][best], c["rows"][best])
        w, k = np.nonzero(found.score != _NONE)
        out.append((a["rows"][a["owner"][w]], a["slot"][w], found.score[w, k], found.id[w, k], found.row[w, k]))
    return out


def _cell(table: pa.Table, width: int, windows: bool) -> list[dict]:
    out = []
    for k in range(table.num_rows):
        one = {c: array_of(table.column(c), k, "<i8") for c in ("ids", "labels", "rows", *(("owner", "slot", "low", "high", "floor") if windows else ()))}
        out.append(one | {"norms": array_of(table.column("norms"), k, "<f8"), "vectors": array_of(table.column("vectors"), k, "<i4").reshape(-1, width), "norm": table.column("norm")[k].as_py(), "need": table.column("need")[k].as_py()})
    return out


def search(blocks: DataFrame, buckets: DataFrame, n_anchors: int, n_buckets: int, width: int, wanted: int, same: bool) -> DataFrame:
    """(row, slot, score, id, other): up to ``wanted`` rows a window and cell, over all cells."""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    slots, strips = max(-(-n_buckets // SLOT), min(n_buckets, 2 * cores), 1), -(-_parts(n_anchors, BLOCK) // (STRIP // RUN))
    names = ["vectors", "ids", "labels", "rows", "norms", "norm", "need"]
    # blocks lie in the order of their needs, so a strip's are alike
    left = blocks.withColumn("strip", F.expr(f"int(shiftright(part, 32) div {STRIP // RUN})"))
    need = left.groupBy("strip").agg(F.min("need").alias("least"))
    upto = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    right = buckets.withColumn("to", F.explode(upto(strips))).withColumn("way", F.pmod(F.xxhash64("part"), F.lit(slots)).cast("int"))
    right = right.join(need.withColumnRenamed("strip", "to"), "to").where(F.col("norm") >= F.col("least") * F.lit(_SLACK)).select("to", "way", *names)
    left = left.withColumn("slot_", F.explode(upto(slots))).select(F.col("strip").alias("l_strip"), F.col("slot_").cast("int").alias("l_slot"), *names, "owner", "slot", "low", "high", "floor")
    schema = pa.schema([("row", pa.int64()), ("slot", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("other", pa.int64())])

    def run(a: pa.Table, c: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and c.num_rows:
            found = searched(_cell(a, width, True), sorted(_cell(c, width, False), key=lambda x: -x["norm"]), wanted, same)
        columns = [np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(5)]
        return pa.table([pa.array(x, pa.int64()) for x in columns], schema=schema)

    return left.groupBy("l_strip", "l_slot").cogroup(right.groupBy("to", "way")).applyInArrow(run, "row long, slot long, score long, id long, other long")


def best(found: DataFrame, wanted: int) -> DataFrame:
    """The first ``wanted`` of each window: adds their rank."""
    order = Window.partitionBy("row", "slot").orderBy(F.col("score").desc(), "id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def two_rounds(anchors: DataFrame, buckets: DataFrame, n_buckets: int, fence: float, width: int, wanted: int, same: bool) -> DataFrame:
    """``best`` of all windows of ``anchors`` (id, label, vector, norm, _row, windows): buckets with the largest norms first, then those that the windows still need."""
    limit = F.array_min(F.transform("windows", lambda w: F.greatest(w.low, w.floor)))
    need = F.when(F.col("norm") > 0, limit / F.col("norm")).when(limit > 0, float("inf")).otherwise(0.0)

    n = anchors.count()

    def once(rows: DataFrame, some: DataFrame, label: str) -> DataFrame:
        blocks = stash(packed(rows, n, [F.col("need"), F.col("_row")], BLOCK, width, True), f"negatives-{label}-blocks")
        found = stash(best(search(blocks, some, n, n_buckets, width, wanted, same), wanted), f"negatives-{label}", narrow=True)
        release(blocks)
        return found

    if n_buckets <= SLOT:
        return once(anchors.withColumn("need", need), buckets, "all")
    first = once(anchors.withColumn("need", need), buckets.where(F.col("norm") >= fence), "first")
    full = first.groupBy("row", "slot").agg(F.when(F.count("*") == wanted, F.min("score")).alias("worst")).where("worst IS NOT NULL")
    by_row = full.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "worst"))).alias("worst"))  # as many as a row has windows
    raised = anchors.join(by_row, anchors["_row"] == by_row["row"], "left").withColumn("windows", F.transform("windows", lambda w: F.struct(w.slot.alias("slot"), w.low.alias("low"), w.high.alias("high"), F.coalesce(F.try_element_at("worst", w.slot), w.floor).alias("floor"))))
    rest = once(raised.drop("row", "worst").withColumn("need", need), buckets.where(F.col("norm") < fence), "rest")
    columns = ["row", "slot", "score", "id", "other"]
    out = stash(best(first.select(columns).union(rest.select(columns)), wanted), "negatives-found", narrow=True)
    release(first, rest)
    return out


def mine(df: DataFrame, anchor: Column, spec: Spec | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, anchor_row; see the module's head. ``anchor`` tells the anchors among the rows of ``df``."""
    spec = spec or Spec()
    spark = df.sparkSession
    small_batches(spark)
    rows = prepared(df, anchor, id_col, vector_col, label_col)
    extent = rows.agg(F.max(F.size("vector")).alias("width"), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))).alias("largest"), F.count("*").alias("n")).first()
    width, largest = max(extent["width"] or 1, 1), extent["largest"] or 0
    if width * largest**2 >= 1 << 50:
        raise ValueError("scores may go beyond 2^50: scale the vectors down")
    per = int(np.clip(BUCKET_BYTES // (8 * width), 64, BUCKET_ROWS))
    buckets = stash(packed(rows, extent["n"], [F.col("norm").desc(), F.col("_row")], per, width, False), "negatives-buckets")
    n_buckets = buckets.count()
    fence = rows.approxQuantile("norm", [1 - FIRST], 0.005)
    fence = fence[0] if fence else 0.0
    fixed = lambda slot, low, high: F.struct(slot.cast("long").alias("slot"), low.cast("long").alias("low"), high.cast("long").alias("high"), F.lit(_NONE).alias("floor"))
    anchors = rows.where("anchor").select("id", "label", "vector", "norm", "_row")
    everything = anchors.withColumn("windows", F.array(fixed(F.lit(0), F.lit(_NONE + 1), F.lit(-_NONE))))
    positives = two_rounds(everything, buckets, n_buckets, fence, width, spec.positives, True)
    pairs = positives.select(F.col("row").alias("_row"), F.col("rank").cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # low * p <= per * n <= high * p, in whole numbers
    low, high = F.expr(f"-((-{spec.low} * positive_score) div {spec.per} - IF((-{spec.low} * positive_score) % {spec.per} < 0, 1, 0))"), F.expr(f"({spec.high} * positive_score) div {spec.per} - IF(({spec.high} * positive_score) % {spec.per} < 0, 1, 0)")
    windows = pairs.withColumn("low", low).withColumn("high", high).where("low <= high").groupBy("_row").agg(F.array_sort(F.collect_list(fixed(F.col("slot"), F.col("low"), F.col("high")))).alias("windows"))  # one a positive
    negatives = two_rounds(anchors.join(windows, "_row"), buckets, n_buckets, fence, width, spec.negatives, False)
    found = negatives.select(F.col("row").alias("_row"), "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(pairs, ["_row", "slot"]).join(anchors.select("_row", F.col("id").alias("anchor_id")), "_row")
    release(buckets)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score", F.col("_row").alias("anchor_row"))
