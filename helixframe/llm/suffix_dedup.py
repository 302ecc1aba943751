"""Removal of repeated passages with suffix arrays by linear grouping construction.

A byte is removed when a string of ``length`` bytes that covers it also starts
earlier (smaller document id, or same document and earlier start). Matches
never cross documents.

1. Each window of ``length`` bytes has an anchor: the leftmost least hash among
   its ``gram``-byte strings. Windows with one anchor form a context (the bytes
   they cover). Equal windows have equal anchors at equal offsets, so only
   contexts of one anchor string need comparing. Per context, its anchor's hash
   and its own hash are shuffled, not its bytes.
2. Of equal contexts all but the first are removed whole. Anchors with a single
   context are done.
3. First contexts of anchors with several different ones bring their bytes to
   the anchor's owner. Their right halves, as strings of aligned blocks, are
   sorted by a suffix array (``suffix_array``); common prefixes of neighbours
   give the classes of equal right parts at every depth, and left parts are
   told apart by their hash. Of each class the earliest window stays.
4. Runs are merged per document.

Null and empty texts have no bytes. Null ids count as the smallest. Of rows
that share an id, those with other texts are documents of their own, in the
order of their texts' hashes; of wholly equal rows all but one count as later
(the text stays once). An empty table gives an empty result; extra columns are
ignored; long texts are read whole, in one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.store import release, stash
from helixframe.llm.textops import Hasher, chunks, grams, mix, signed

LENGTH = 100
GRAM = 20
BLOCK = 8
_OWNED = 20_000
_PLACE = 31  #: bits of a position in a chunk; the other bits of an anchor's rank are its hash's, in chunks of any length


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers by grouping (linear work, no renaming).

    Suffixes are grouped by their longest Lyndon prefix found so far, first by
    symbol. Groups are taken in descending order: each member points to the
    previous suffix of a lower group, and the suffixes pointed at leave their
    group for a new one just above, the more often pointed at the higher, their
    prefix extended by the taken group's. At the end a suffix is its Lyndon
    prefix followed by its next smaller suffix; so, in ascending order, every
    placed suffix places those it follows, at the next free place of their group.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    symbols = np.append(np.asarray(text, np.int64) + 1, 0)
    order = np.argsort(symbols, kind="stable")
    n += 1
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    edge = np.concatenate(([True], symbols[order][1:] != symbols[order][:-1]))
    first = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    head = np.empty(n, np.int64)
    head[order] = first
    rows, at, head = order.tolist(), place.tolist(), head.tolist()
    end = [0] * n
    starts = np.flatnonzero(edge).tolist()
    for a, b in zip(starts, [*starts[1:], n], strict=True):
        end[a] = b
    length, before = [1] * n, [-2] * n
    top = n
    while top > 0:
        low = head[rows[top - 1]]
        members = rows[low:top]
        if len(members) > 1:
            members.sort()
        size = length[members[0]]
        hits: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and head[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        if hits:
            most = max(hits.values())
            ranked: list[list[int]] = [[] for _ in range(most)]
            for p, c in hits.items():
                ranked[most - c].append(p)
            for chosen in ranked:
                fresh: dict[int, int] = {}
                for p in chosen:  # move to the end of its group
                    g = head[p]
                    to = end[g] - 1 - fresh.get(g, 0)
                    fresh[g] = fresh.get(g, 0) + 1
                    other, here = rows[to], at[p]
                    rows[to], rows[here] = p, other
                    at[p], at[other] = to, here
                    length[p] += hits[p] * size
                for g, c in fresh.items():
                    if c == end[g] - g:
                        continue  # the whole group moved: it stays one group
                    new = end[g] - c
                    end[new], end[g] = end[g], new
                    for k in range(new, end[new]):
                        head[rows[k]] = new
        top = low
    following = np.arange(n) + np.array(length)
    inner = np.flatnonzero(following < n)
    by_next = inner[np.argsort(following[inner], kind="stable")]
    cut = np.searchsorted(following[by_next], np.arange(n + 1)).tolist()
    by_next = by_next.tolist()
    fill = list(range(n))
    out = [-1] * n
    out[0] = n - 1
    for k in range(n):
        s = out[k]
        for j in by_next[cut[s] : cut[s + 1]]:
            g = head[j]
            out[fill[g]] = j
            fill[g] += 1
    return np.array(out[1:], np.int64)


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, context hash, first window, last window, anchor), one entry a context; positions in the document."""
    n, w = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none, none
    hasher = Hasher(data)
    h = grams(data, gram)
    bits = np.uint64(_PLACE)
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)  # the leftmost wins ties
    padded = np.full(-(-len(key) // w) * w + w, ~np.uint64(0))
    padded[: len(key)] = key
    table = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(table, 1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    p = np.arange(n - length + 1)
    least = np.minimum(behind[p], ahead[p + w - 1])
    doc = np.searchsorted(offsets, p, "right") - 1
    good = p + length <= offsets[doc + 1]
    p, doc, least = p[good], doc[good], least[good]
    if not len(p):
        return none, none, none, none, none, none
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(p)) - 1
    a = anchor[lo]
    base = offsets[doc[lo]]
    whole = mix(hasher.of(p[lo], p[hi] + length) + (a - p[lo]).astype(np.uint64))
    return doc[lo], signed(h[a]), signed(whole), p[lo] - base, p[hi] - base, a - base


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, row (hash of the text) and k (hash of id and row): a document is known by (k, row), in the order of (id, row)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("row", F.xxhash64("text"))
    return rows.withColumn("k", F.xxhash64("id", "row"))


def _dense(ids: pa.Array, row: np.ndarray) -> np.ndarray:
    """Rank of each document of a batch by (id, row); equal for repeated rows."""
    rank = np.asarray(pc.rank(ids, tiebreaker="dense", null_placement="at_start"), np.int64)
    order = np.lexsort((row, rank))
    out = np.zeros(len(order), np.int64)
    out[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (row[order[1:]] != row[order[:-1]]))
    return out


def context_rows(df: DataFrame, length: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    key = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                doc, anchor, whole, first, last, at = contexts(data, offsets, length, gram)
                ids = batch.column(0).slice(lo, hi - lo)
                row = batch.column(2).slice(lo, hi - lo).to_numpy()
                copy = _later(_dense(ids, row)[doc], whole, anchor, first)
                spread = signed(mix(whole.view(np.uint64) + mix((doc << 32 | first).astype(np.uint64) + np.uint64(lo))))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(row[doc]), pa.array(np.where(copy, spread, anchor)), pa.array(whole), *(pa.array(x.astype(np.int32)) for x in (first, last, at)), pa.array(copy)], ["id", "row", "anchor", "whole", "first", "last", "at", "copy"])

    return keyed(df, id_col, text_col).select("id", "text", "row").mapInArrow(run, f"id {key}, row long, anchor long, whole long, first int, last int, at int, copy boolean")


def _later(rank: np.ndarray, whole: np.ndarray, anchor: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether an equal context comes earlier in the chunk."""
    order = np.lexsort((first, rank, whole))
    later = np.zeros(len(order), bool)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        later[a] = (whole[a] == whole[b]) & (anchor[a] == anchor[b]) & ((rank[a] != rank[b]) | (first[a] != first[b]))
    return later


def with_bytes(rows: DataFrame, df: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """Adds each row's context bytes."""
    key = df.schema[id_col].dataType.simpleString()
    one = F.struct("anchor", "first", "last", "at")
    lists = rows.groupBy(F.xxhash64("id", "row").alias("k"), "row").agg(F.collect_set(one).alias("rows"))  # a document's own contexts
    turn = F.row_number().over(Window.partitionBy("k", "row").orderBy("k"))
    texts = keyed(df, id_col, text_col).withColumn("turn", turn).where("turn = 1")
    joined = texts.join(lists, ["k", "row"]).select("id", "text", "rows", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py().encode()
                held = batch.column(2)[k].values
                anchor, first, last, at = (held.field(c) for c in range(4))
                cut = [text[a : b + length] for a, b in zip(first.to_pylist(), last.to_pylist(), strict=True)]
                own = pa.array(np.full(len(cut), k))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(3).take(own), anchor, first, last, at, pa.array(cut, pa.binary())], ["id", "row", "anchor", "first", "last", "at", "bytes"])

    return joined.mapInArrow(run, f"id {key}, row long, anchor long, first int, last int, at int, bytes binary")


def repeated(group: np.ndarray, rank: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(context, window start) of windows that occur earlier in another context of the same group.

    ``rank`` orders the contexts by document and position.
    """
    m = len(texts)
    right = [t[a:] for t, a in zip(texts, (at - first).tolist(), strict=True)]
    wide = -(-length // BLOCK) * BLOCK
    table = np.frombuffer(b"".join(r[:wide].ljust(wide, b"\0") for r in right), np.uint8).reshape(m, wide)
    n_right = np.array([len(r) for r in right])
    blocks = table.reshape(m, -1, BLOCK).copy().view(">u8")[:, :, 0]
    symbols = np.unique(blocks, return_inverse=True)[1].reshape(blocks.shape) + 1
    _, group_code = np.unique(group, return_inverse=True)
    # each string: its group, its blocks, and a separator below all
    strings = np.concatenate((group_code[:, None] + symbols.max() + 1, symbols, np.zeros((m, 1), np.int64)), axis=1)
    flat = suffix_array(strings.ravel())
    order = flat[flat % strings.shape[1] == 0] // strings.shape[1]
    same = table[order[1:]] == table[order[:-1]]
    shared = np.where(same.all(1), wide, np.argmin(same, 1))
    shared = np.minimum(shared, np.minimum(n_right[order[1:]], n_right[order[:-1]]))
    shared[group_code[order[1:]] != group_code[order[:-1]]] = -1
    shared = np.concatenate(([-1], shared))
    joined = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum([0, *map(len, texts)])[:-1]
    middle = begin + at - first
    reach, least = at - first, at - last  # offsets of the windows before the anchor
    left = np.zeros(m, np.uint64)  # hash of the delta bytes before the anchor
    every = np.arange(256, dtype=np.uint64)
    for delta in range(int(reach.max(initial=-1)) + 1):
        if delta:
            left += mix(every + np.uint64(delta << 8))[joined[np.maximum(middle - delta, 0)]]
        cls = np.cumsum(shared < length - delta)
        here = np.flatnonzero((reach[order] >= delta) & (least[order] <= delta))
        if len(here) < 2:
            continue
        rows = order[here]
        key = mix(left[rows] + cls[here].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        by = np.lexsort((rank[rows], key))
        again = np.concatenate(([False], key[by][1:] == key[by][:-1]))
        found = rows[by[again]]
        yield found, at[found] - delta


def resolve(rows: DataFrame, length: int) -> DataFrame:
    """(id, row, start, end) runs to remove among contexts of the same anchor."""
    key = rows.schema["id"].dataType.simpleString()
    size = F.col("anchor")
    ordered = rows.repartition(size).sortWithinPartitions("anchor", F.col("id").asc_nulls_first(), "row", "first")

    def solve(part: pa.Table, kind: pa.DataType) -> pa.RecordBatch:
        group, first, last, at = (part.column(c).to_numpy().astype(np.int64) for c in ("anchor", "first", "last", "at"))
        texts = part.column("bytes").to_pylist()
        found = list(repeated(group, np.arange(len(group)), first, last, at, texts, length))  # rows come in order
        at_row, start = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]) for k in (0, 1))
        by = np.lexsort((start, at_row))
        at_row, start = at_row[by], start[by]
        new = np.concatenate(([True], (at_row[1:] != at_row[:-1]) | (start[1:] != start[:-1] + 1)))[: len(at_row)]
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(at_row))[: len(lo)] - 1
        ids, rows_ = (part.column(c).combine_chunks().take(pa.array(at_row[lo])) for c in ("id", "row"))
        return pa.RecordBatch.from_arrays([ids.cast(kind), rows_, pa.array(start[lo].astype(np.int32)), pa.array((start[hi] + length).astype(np.int32))], ["id", "row", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = 0
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            held.append(batch)
            waiting += batch.num_rows
            if waiting >= _OWNED:
                table = pa.Table.from_batches(held)
                anchor = table.column("anchor").to_numpy()
                cut = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if (anchor != anchor[-1]).any() else 0
                if cut:
                    yield solve(table.slice(0, cut), kind)
                    held = table.slice(cut).to_batches()
                    waiting = table.num_rows - cut
        if waiting:
            yield solve(pa.Table.from_batches(held), kind)

    return ordered.select("id", "row", "anchor", "first", "last", "at", "bytes").mapInArrow(run, f"id {key}, row long, start int, end int")


def removals(df: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, row, start, end) byte runs that are removed (they may overlap), and the written table they come from.

    A context with an equal one earlier in its chunk is a copy already: it goes
    on under a key of its own, so that text repeated in a document is not hot.
    """
    rows = context_rows(df, length, gram, id_col, text_col)
    same = Window.partitionBy("anchor")
    order = Window.partitionBy("anchor", "whole").orderBy(F.col("id").asc_nulls_first(), "row", "first")
    ranked = (
        rows.withColumn("turn", F.dense_rank().over(order)).withColumn("lo", F.min("whole").over(same)).withColumn("hi", F.max("whole").over(same))
        .where("copy OR turn > 1 OR lo != hi")
        .select("id", "row", "anchor", "first", "last", "at", (F.col("copy") | (F.col("turn") > 1)).alias("copy"))
    )
    ranked = stash(ranked, "repeat-contexts")
    copies = ranked.where("copy").select("id", "row", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    mixed = ranked.where("NOT copy").select("id", "row", "anchor", "first", "last", "at")
    return copies.union(resolve(with_bytes(mixed, df, length, id_col, text_col), length)), ranked


def dedup(df: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``texts`` also the remaining bytes (``kept``)."""
    found, ranked = removals(df, length, gram, id_col, text_col)
    runs = stash(found, "repeat-runs")
    release(ranked)
    lists = runs.groupBy(F.xxhash64("id", "row").alias("k"), "row").agg(F.collect_list(F.struct("start", "end")).alias("runs"))  # a document's own runs
    turn = F.row_number().over(Window.partitionBy("k", "row").orderBy("k"))
    joined = keyed(df, id_col, text_col).withColumn("turn", turn).join(lists, ["k", "row"], "left").select("id", "text", "runs", (F.col("turn") > 1).alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py().encode()
                removed = spans = 0
                kept = text
                if batch.column(3)[k].as_py():  # the same row again
                    if len(text) >= length:
                        removed, spans, kept = len(text), 1, b""
                elif batch.column(2)[k].is_valid:
                    held = batch.column(2)[k].values
                    start, end = (held.field(c).to_numpy().astype(np.int64) for c in (0, 1))
                    by = np.argsort(start, kind="stable")
                    start, end = start[by], np.minimum(np.maximum.accumulate(end[by]), len(text))
                    new = np.concatenate(([True], start[1:] > end[:-1]))
                    lo = start[new]
                    hi = end[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
                    removed, spans = int((hi - lo).sum()), len(lo)
                    edge = [0, *np.stack((lo, hi), 1).ravel().tolist(), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
                out.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
            columns = list(zip(*out, strict=True)) or [[]] * (5 if texts else 4)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=False))], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns) + 1])

    key = df.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id_col}` {key}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else ""))
