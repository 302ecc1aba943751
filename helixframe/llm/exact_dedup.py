"""Exact dedup by an extendible-hash index on shared files; DataFrame functions only.

Rows are grouped by (key, normalised bytes), which compares texts byte for byte
and merges copies before any shuffle, so a hot group is one entry with its row
count and largest id. Histograms of key prefixes drive directory doubling: an
overfull bucket splits on its next prefix bit until each bucket fits or its
entries share one whole key. Owner tasks take the buckets' key ranges, chain the
texts that collide on a key, and write the index to the shared folder. A row
finds its bucket in the directory, its chain by bucket and key, and its entry
in the chain by the digest of its bytes; a row without an entry is an error, not
a text of its own. The entries of keys with many rows are repeated, and the rows dealt to the
repeats, so no task holds a hot key. The row with the largest id of equal texts
stays.

The directory is kept as its buckets' first keys: all slots of a bucket lie
side by side, so doubling copies nothing. Histograms are taken ``PREFIX_BITS``
at a time, deeper ones for overfull buckets only.

Nulls count as empty text. Of repeated rows with the same id one keeps the id,
all name it. Null ids lose to others. An empty table gives an empty result.
Extra columns are ignored by ``classes``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.sharding import bucket_of
from helixframe.llm.store import release, stash

KEY_BITS = 63
PREFIX_BITS = 9
#: Buckets hold a 256th of all entries by default, or this many.
BUCKET_ENTRIES = 1 << 6
#: Rows of a key that one task looks up, at least; keys with more than that and a 1024th of all rows are dealt to several.
HOT_ROWS = 1 << 12


def normalised(text: Column) -> Column:
    """A to Z lower-cased, all else kept; null is empty. The fast path is for pure ASCII."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def text_key(text: Column) -> Column:
    """Key of ``KEY_BITS`` bits, not negative."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS)


def split(first: int, depth: int, counts: dict[int, int], bits: int, capacity: int) -> list[tuple[int, int, int]]:
    """(prefix, depth, entries) of the buckets that the bucket ``first`` at ``depth`` splits into, by entries per prefix of ``bits`` bits."""
    out, work = [], [(first, depth, counts)]
    while work:
        prefix, local, held = work.pop()
        if sum(held.values()) <= capacity or local == bits:
            out.append((prefix, local, sum(held.values())))
            continue
        shift = bits - local - 1
        for bit in (1, 0):
            work.append((prefix << 1 | bit, local + 1, {p: n for p, n in held.items() if p >> shift & 1 == bit}))
    return out


def directory(entries: DataFrame, capacity: int) -> list[tuple[int, int]]:
    """(first key, depth) of each bucket, ascending."""
    done, open_ = [], [(0, 0)]
    while open_:
        bits = min(KEY_BITS, open_[0][1] + PREFIX_BITS)  # open buckets have one depth
        prefix = F.shiftrightunsigned("_key", KEY_BITS - bits)
        rows = entries.select(prefix.alias("p"))
        if open_[0][1]:
            rows = rows.where(F.shiftrightunsigned("p", bits - open_[0][1]).isin([p for p, _ in open_]))  # overfull ones: fewer than entries / capacity
        counts: dict[int, dict[int, int]] = {p: {} for p, _ in open_}
        for r in rows.groupBy("p").agg(F.count("*").alias("n")).collect():  # a row a prefix of an open bucket
            counts[r["p"] >> bits - open_[0][1]][r["p"]] = r["n"]
        found = [b for p, depth in open_ for b in split(p, depth, counts[p], bits, capacity)]
        done += [(p << KEY_BITS - depth, depth) for p, depth, n in found if n <= capacity or depth == KEY_BITS]
        open_ = [(p, depth) for p, depth, n in found if n > capacity and depth < KEY_BITS]
    return sorted(done)


def bucket(key: Column, buckets: list[tuple[int, int]]) -> Column:
    """Number of the bucket that the directory names for a key."""
    return bucket_of(key, [first for first, _ in buckets]) - 1


def build_index(entries: DataFrame, buckets: list[tuple[int, int]], hot: int) -> DataFrame:
    """(_bucket, _key, _copy, _chain) written by bucket: entries that collide on a key in one chain, repeated for each ``hot`` rows of the key."""
    entry = F.struct("text_sha256", "group_size", "keep_id")
    owned = entries.withColumn("_bucket", bucket(F.col("_key"), buckets)).repartitionByRange("_bucket", "_key")
    # a chain is as long as different texts share a key of 63 bits
    chains = owned.groupBy("_bucket", "_key").agg(F.array_sort(F.collect_list(entry)).alias("_chain"), F.sum("group_size").alias("_n"))
    copies = F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / hot).cast("int"))
    return stash(chains.select("_bucket", "_key", F.explode(copies).alias("_copy"), "_chain"), "dedup-index")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, key: Callable[[Column], Column] = text_key, hot_rows: int = HOT_ROWS) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 (of the normalised text) for every row."""
    texts = df.select(F.col(id_col), normalised(F.col(text_col)).alias("_t")).withColumn("_key", key(F.col("_t")))
    # the aggregate's map holds and compares the texts' bytes; copies meet before the shuffle
    groups = texts.groupBy("_key", "_t").agg(F.count("*").alias("group_size"), F.max(id_col).alias("keep_id"))
    entries = stash(groups.select("_key", F.sha2("_t", 256).alias("text_sha256"), "group_size", "keep_id"), "dedup-entries")
    n, total = entries.agg(F.count("*"), F.coalesce(F.sum("group_size"), F.lit(0))).first()
    buckets = directory(entries, capacity or max(BUCKET_ENTRIES, n // 256))
    hot = max(hot_rows, total // 1024)
    often = {r["_key"]: -(-r["n"] // hot) for r in entries.groupBy("_key").agg(F.sum("group_size").alias("n")).where(F.col("n") > hot).collect()}  # 1024 keys at most
    index = build_index(entries, buckets, hot)
    release(entries)
    copy = F.lit(0)
    if often:
        keys = sorted(often)
        at = bucket_of(F.col("_key"), keys) - 1
        copies = F.when(F.get(F.array(*[F.lit(k) for k in keys]), at) == F.col("_key"), F.get(F.array(*[F.lit(often[k]) for k in keys]), at))
        copy = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce(copies, F.lit(1))).cast("int")
    rows = texts.select(id_col, "_key", bucket(F.col("_key"), buckets).alias("_bucket"), copy.alias("_copy"), F.sha2("_t", 256).alias("text_sha256"))
    found = rows.join(index, ["_bucket", "_key", "_copy"], "left")
    own = F.get(F.filter("_chain", lambda e: e["text_sha256"] == F.col("text_sha256")), 0)
    named = found.withColumn("_e", F.coalesce(own, F.raise_error(F.lit("a text is missing from the index"))))
    return named.select(id_col, F.col("_e.keep_id").alias("keep_id"), F.col("_e.group_size").alias("group_size"), F.col(id_col).eqNullSafe(F.col("_e.keep_id")).alias("kept"), "text_sha256")
