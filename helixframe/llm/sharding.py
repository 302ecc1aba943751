"""Size-balanced shards by sampled splitters; DataFrame functions only.

Records are ordered by a hash of their text, so equal texts stay together. A
size-weighted sample of keys (bounded) gives quantile boundaries for fine
ranges; records are range-partitioned by them and the ranges measured exactly.
Overfull ranges are subdivided: a group of equal texts heavier than a fine
range becomes a range of its own, and the rest of the range is cut at equal
steps of the key. Ranges, heaviest first, go to the lightest shard. While the
largest shard then exceeds the smallest by more than a fine range, the heaviest
group on the largest is split by row into parts of half a fine range, and all
are placed again; so groups stay whole unless the law demands a split, and only a single
record heavier than a fine range can leave shards further apart. Slots are
numbered within chunks of a shard and offset by the chunks before, so no task
orders a whole shard.

A null text has no bytes (size 1, crc of empty bytes) and counts as empty.
Repeated rows get separate slots; parts and chunks are dealt by row, so neither
null nor repeated ids gather in one task. Null ids are placed like others. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.store import stash

FINE = 64
CHUNK_ROWS = 20_000
_SPAN = 1 << 62


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` (ascending) at or below ``value``, by binary search."""
    if not bounds:
        return F.lit(0)
    steps, step = [], 1 << (len(bounds).bit_length() - 1)
    while step:
        steps.append(F.lit(step))
        step >>= 1
    table = F.array(*[F.lit(b) for b in bounds])
    search = lambda v: F.aggregate(F.array(*steps), F.lit(0), lambda at, s: F.when(F.get(table, at + s - 1) <= v, at + s).otherwise(at))
    return F.get(F.transform(F.array(value), search), 0)  # bound once: the fold would evaluate it at every step


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 2).alias("_key"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.col(id_col), F.lit(11)), F.lit(_SPAN)).alias("_draw"),  # fixed by the written table
    )


def splitters(records: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantile boundaries of a size-weighted sample of about 16 keys a range."""
    wanted = 16 * ranges
    hits = F.floor(F.col("size") * F.lit(wanted / total) + F.col("_draw") / F.lit(float(_SPAN)))
    sample = records.select("_key", hits.cast("int").alias("w")).where("w > 0").collect()  # about `wanted` rows, whatever the input
    keys = sorted((r["_key"], r["w"]) for r in sample)
    weight, out, run = sum(w for _, w in keys), [], 0
    for key, w in keys:
        run += w
        while len(out) < ranges - 1 and run >= weight * (len(out) + 1) / ranges:
            out.append(key)
    return sorted(set(out))


def place(units: dict[tuple[int, int], int], shards: int) -> tuple[dict[tuple[int, int], int], list[int]]:
    """(shard of each unit, load of each shard): the heaviest first, each to the lightest shard."""
    lightest, placed, load = [(0, s) for s in range(shards)], {}, [0] * shards
    for u, b in sorted(units.items(), key=lambda x: (-x[1], x[0])):
        at, s = heapq.heappop(lightest)
        placed[u] = s
        load[s] = at + b
        heapq.heappush(lightest, (at + b, s))
    return placed, load


def split_groups(units: dict[tuple[int, int], int], shards: int, mean: float) -> dict[int, int]:
    """Into how many parts, of half a fine range each, to split which groups (units below range 0) so that shards get near equal; arithmetic on a bounded table."""
    parts: dict[int, int] = {}
    while units:
        now = {}
        for (r, p), b in units.items():
            n = parts.get(r, 1)
            now |= {(r, k if r < 0 else p): b // n for k in range(n)}
        placed, load = place(now, shards)
        if max(load) - min(load) <= mean:
            break
        fullest = load.index(max(load))
        whole = [(b, u[0]) for u, b in now.items() if u[0] < 0 and u[0] not in parts and placed[u] == fullest]
        if not whole:
            break
        b, chosen = max(whole)
        parts[chosen] = int(2 * b // mean) + 1
    return parts


def shard(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", fine: int = FINE) -> DataFrame:
    """id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null under this law)."""
    records = stash(keyed(df, id_col, text_col), "shard-keys")
    total, n = records.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = shards * fine
    bounds = splitters(records, total, ranges) if total else []
    ranged = records.withColumn("_range", bucket_of(F.col("_key"), bounds))
    sizes = {r["_range"]: r["b"] for r in ranged.groupBy("_range").agg(F.sum("size").alias("b")).collect()}  # a row a range
    mean = max(1.0, total / ranges)
    overfull = [r for r, b in sizes.items() if b > 1.5 * mean]
    heavy: dict[int, int] = {}
    if overfull:
        groups = ranged.where(F.col("_range").isin(overfull)).groupBy("_range", "_key").agg(F.sum("size").alias("b")).where(F.col("b") > mean)
        rows = groups.collect()  # each outweighs a mean range, so fewer than there are ranges
        heavy = {r["_key"]: r["b"] for r in rows}
        for r in rows:
            sizes[r["_range"]] -= r["b"]
    edge = [0, *bounds, _SPAN]
    cuts = {r: int(b // mean) + 1 for r, b in sizes.items() if b > 1.5 * mean}
    part = F.lit(0)
    for r, c in cuts.items():
        low, high = edge[r], edge[r + 1]
        width = max(1, (high - low) // c)
        part = F.when(F.col("_range") == r, F.least(F.lit(c - 1), F.greatest(F.lit(0), ((F.col("_key") - F.lit(low)) / F.lit(float(width))).cast("int")))).otherwise(part)
    unit = F.struct(F.col("_range").alias("r"), part.cast("int").alias("p"))
    groups = sorted(heavy)
    if groups:
        rank = bucket_of(F.col("_key"), groups) - 1
        is_heavy = F.coalesce(F.get(F.array(*[F.lit(k) for k in groups]), rank) == F.col("_key"), F.lit(False))
        unit = F.when(is_heavy, F.struct((-rank - 1).alias("r"), F.lit(0).alias("p"))).otherwise(unit)
    united = ranged.withColumn("_unit", unit)
    measured = {(r["r"], r["p"]): r["b"] for r in united.groupBy("_unit.r", "_unit.p").agg(F.sum("size").alias("b")).collect()}  # a row a range
    parts = split_groups(measured, shards, mean)
    if parts:
        pieces = F.get(F.array(*[F.lit(parts.get(-k - 1, 1)) for k in range(len(groups))]), -F.col("_unit.r") - 1)
        united = united.withColumn("_unit", F.when(F.col("_unit.r") < 0, F.struct(F.col("_unit.r").alias("r"), F.pmod(F.col("_draw"), pieces).cast("int").alias("p"))).otherwise(F.col("_unit")))
        measured = {(r["r"], r["p"]): r["b"] for r in united.groupBy("_unit.r", "_unit.p").agg(F.sum("size").alias("b")).collect()}
    placed, _ = place(measured, shards)
    order = sorted(placed)
    code = F.col("_unit.r").cast("long") * 65536 + F.col("_unit.p")
    target = F.get(F.array(*[F.lit(placed[u]) for u in order]), bucket_of(code, [r * 65536 + p for r, p in order]) - 1) if order else F.lit(0)
    rows = united.select(id_col, "size", "text_crc32", target.cast("int").alias("shard"), F.pmod(F.col("_draw"), F.lit(max(1, n // shards // CHUNK_ROWS + 1))).alias("_chunk"))
    return numbered(rows, id_col)


def numbered(rows: DataFrame, id_col: str) -> DataFrame:
    """Slots: position within (shard, chunk) plus the rows of the shard's chunks before."""
    counts = rows.groupBy("shard", "_chunk").agg(F.count("*").alias("_n"))
    before = counts.select("shard", "_chunk", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy(F.col(id_col), "text_crc32", "size"))
    return (
        rows.withColumn("_inside", inside)
        .join(before, ["shard", "_chunk"])
        .select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_inside") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
