"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary resolves whole pre-tokens
that are themselves vocabulary entries, for a whole chunk of text at once.
Tier 2: each distinct miss is merged once by a heap over linked bytes and kept
in a per-worker table of bounded size.

Pre-tokens are the matches of the usual pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``,
found by class runs over code points instead of a regex engine.

Nulls and empty texts give no ids. Extra columns are ignored by ``encode`` /
``round_trip`` except the id column, which is passed through (null ids too);
repeated rows give repeated results. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixframe.llm.textops import Hasher, blocks, chunks, mix, same_slices

KEEP_MISSES = 1_000_000
KEEP_BYTES = 1 << 26
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PerfectHash:
    """Minimal perfect hash by displacement; slots hold the full 64-bit hash; who looks up compares the bytes."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.n, self.buckets = n, max(1, n // 4)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        first = np.concatenate(([0], np.cumsum(counts)))
        free, owner = np.ones(n, bool), np.zeros(n, np.int64)
        self.shift = np.zeros(self.buckets, np.int64)
        self.key = np.zeros(n, np.uint64)
        self.slot_of = np.zeros(n, np.int64)
        for size in range(int(counts.max()), 1, -1):  # all buckets of a size together, each from its own shift on
            todo = np.flatnonzero(counts == size)
            members, shift = order[first[todo, None] + np.arange(size)], np.ones(len(todo), np.int64)
            while len(todo):
                tries = shift[:, None] + np.arange(max(1, min(1 << 12, (1 << 14) // (len(todo) * size))))
                slots = self._place(hashes[members][:, None, :], tries[:, :, None].astype(np.uint64))
                good = free[slots].all(2)
                ranked = np.sort(slots[good], 1)
                good[good] = (ranked[:, 1:] != ranked[:, :-1]).all(1)
                k, some = good.argmax(1), np.flatnonzero(good.any(1))
                taken = slots[some, k[some]]
                owner[taken[::-1].ravel()] = np.repeat(some[::-1], size)  # the first bucket that wants a slot has it
                won = (owner[taken] == some[:, None]).all(1)
                some, taken = some[won], taken[won]
                self.shift[todo[some]] = tries[some, k[some]]
                free[taken] = False
                self.slot_of[members[some]] = taken
                shift = np.where(good.any(1), shift, tries[:, -1] + 1)
                left = np.ones(len(todo), bool)
                left[some] = False
                todo, members, shift = todo[left], members[left], shift[left]
        single = np.flatnonzero(counts == 1)
        left = np.flatnonzero(free)
        self.shift[single] = -left[: len(single)] - 1
        self.slot_of[order[first[single]]] = left[: len(single)]
        self.key[self.slot_of] = hashes

    def _place(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(h ^ (shift * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(self.n)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1."""
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -shift - 1, self._place(h, shift.astype(np.uint64)))
        return np.where(self.key[slot] == h, slot, -1)


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: lowest rank first, leftmost on ties, by a heap over linked bytes."""
    n = len(piece)
    if piece in ranks:
        return [ranks[piece]]
    none = 1 << 60
    get = ranks.get
    after = list(range(1, n + 2))
    before = list(range(-1, n))
    pair = [get(piece[i : i + 2], none) for i in range(n - 1)] + [none]
    heap = [r * n + i for i, r in enumerate(pair) if r < none]
    heapq.heapify(heap)
    while heap:
        r, i = divmod(heapq.heappop(heap), n)
        if pair[i] != r:
            continue
        j = after[i]
        k = after[j]
        pair[j] = none
        after[i] = k
        if k <= n:
            before[k] = i
        if k < n:
            r = pair[i] = get(piece[i : after[k]], none)
            if r < none:
                heapq.heappush(heap, r * n + i)
        else:
            pair[i] = none
        p = before[i]
        if p >= 0:
            r = pair[p] = get(piece[p:k], none)
            if r < none:
                heapq.heappush(heap, r * n + p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class IdTable:
    """Growing table byte string -> id list; beyond ``limit`` entries only those looked up again since the last time stay.

    Hashes are kept in two sorted arrays, the smaller one merged into the larger
    as it grows; strings are held too, and compared with what is looked up. A
    string that shares its hash with another one is made anew each time.
    """

    def __init__(self, limit: int = KEEP_MISSES):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.levels = [none, none]
        self.n = self.used = self.n_bytes = 0
        self.start, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.text_at, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.again = np.zeros(1 << 12, bool)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.text = np.zeros(1 << 16, np.uint8)

    def thin(self) -> None:
        """Drop what was not looked up again since it came or was kept; all, if that leaves too much."""
        keys, slots = (np.concatenate(x) for x in zip(*self.levels, strict=True))
        stays = self.again[slots]
        keys, slots = keys[stays], slots[stays]
        size, counts = self.size[slots], self.count[slots]
        if 4 * len(slots) > 3 * self.limit or 2 * int(size.sum()) > KEEP_BYTES:
            self.clear()
            return
        text, flat = self.text[spread(size, self.text_at[slots])], self.flat[spread(counts, self.start[slots])]
        self.clear()
        self.add(keys, text, np.cumsum(size) - size, size, counts, flat)

    def add(self, keys: np.ndarray | None, data: np.ndarray, start: np.ndarray, size: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """New slots for slices of ``data``; without ``keys`` no later look-up finds them."""
        slots = np.arange(self.n, self.n + len(start))
        self.n += len(slots)
        while self.n > len(self.start):
            self.start, self.count, self.text_at, self.size, self.again = (np.resize(x, 2 * len(x)) for x in (self.start, self.count, self.text_at, self.size, self.again))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.count[slots], self.again[slots] = counts, False
        self.start[slots] = self.used + np.cumsum(counts) - counts
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        if keys is None:
            return slots
        held = data[spread(size, start)]
        while self.n_bytes + len(held) + 8 > len(self.text):
            self.text = np.resize(self.text, 2 * len(self.text))
        self.text[self.n_bytes : self.n_bytes + len(held)] = held
        self.text_at[slots] = self.n_bytes + np.cumsum(size) - size
        self.size[slots] = size
        self.n_bytes += len(held)
        large, small = self.levels
        small = _merged(small, (keys, slots))
        if len(small[0]) > 1 << 14 and 8 * len(small[0]) > len(large[0]):
            large, small = _merged(large, small), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.levels = [large, small]
        return slots

    def slots(self, hasher: Hasher, h: np.ndarray, start: np.ndarray, size: np.ndarray, make) -> np.ndarray:
        """Slot of each slice of the hasher's data; ``make(positions)`` gives (counts, ids) of those not held."""
        if self.n > self.limit or self.n_bytes > KEEP_BYTES:
            self.thin()
        keys, at, back = np.unique(h, return_index=True, return_inverse=True)
        found = np.full(len(keys), -1)
        for have, slot in self.levels:
            if len(have):
                near = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                found = np.where(have[near] == keys, slot[near], found)
        held = np.flatnonzero(found >= 0)
        new = np.flatnonzero(found < 0)
        other = np.zeros(len(h), bool)  # slices that differ from the one that has their hash
        if len(held):
            view, slot, own = np.ndarray((len(self.text) - 7,), "<u8", self.text, 0, (1,)), found[held], at[held]
            self.again[slot] = True
            same = self.size[slot] == size[own]
            same[same] = same_slices(view, self.text_at[slot[same]], hasher.at, start[own[same]], size[own[same]])
            if not same.all():
                foreign = np.zeros(len(keys), bool)
                foreign[held[~same]] = True
                other |= foreign[back]
        lead = at[back]
        repeat = np.flatnonzero(lead != np.arange(len(h)))
        same = size[repeat] == size[lead[repeat]]
        same[same] = same_slices(hasher.at, start[repeat[same]], hasher.at, start[lead[repeat[same]]], size[repeat[same]])
        other[repeat[~same]] = True
        if len(new):
            found[new] = self.add(keys[new], hasher.data, start[at[new]], size[at[new]], *make(at[new]))
        out = found[back]
        if other.any():
            rows = np.flatnonzero(other)
            out[rows] = self.add(None, hasher.data, start[rows], size[rows], *make(rows))
        return out


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, slots = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    order = np.argsort(keys, kind="stable")
    return keys[order], slots[order]


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return counts, np.fromiter((x for ids in lists for x in ids), np.uint32, int(counts.sum()))


def spread(count: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Indices ``source[i], source[i]+1, ...`` (``count[i]`` of them) for all i, in order."""
    to = np.cumsum(count) - count
    return np.repeat(source - to, count) + np.arange(int(count.sum()))


_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    global _classes
    if _classes is None:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x40000):  # beyond are no letters or numbers
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                table[c] = _LETTER
            elif kind == "N":
                table[c] = _NUMBER
        table[_WHITE] = _SPACE
        _classes = table
    return _classes


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte starts of the pattern's matches in each document (documents are separate texts)."""
    n_bytes = len(data)
    if not n_bytes:
        return np.zeros(0, np.int64)
    where = np.flatnonzero((data & 0xC0) != 0x80)
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(chars)
    kind = char_classes()[chars]
    first = np.searchsorted(where, offsets[:-1][offsets[:-1] < n_bytes])
    doc = np.zeros(n + 4, bool)
    doc[first] = True
    doc[n:] = True
    run = doc[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    space = kind == _SPACE
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~doc[1:n]
    start |= last
    bound = np.flatnonzero(last & (chars == 0x20)) + 1
    start[bound] = False
    mark = np.flatnonzero((chars == 0x27) & run & start)
    if len(mark):
        pad = np.concatenate((chars, np.zeros(4, np.uint32)))
        one, two = pad[mark + 1], pad[mark + 2]
        next_in = ~doc[mark + 1]
        short = next_in & np.isin(one, [ord(c) for c in "stmd"])
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        long = next_in & ~doc[mark + 2] & np.logical_or.reduce([(one == a) & (two == b) for a, b in pairs])
        start = np.concatenate((start, np.ones(4, bool)))
        start[mark[short | long] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 3] = True
        start = start[:n]
    return where[np.flatnonzero(start)]


class ByteBPE:
    """Vocabulary with its perfect hash; ``encode`` works on a chunk of documents."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        ids = np.array([self.ranks[t] for t in tokens], np.int64)
        size = np.array([len(t) for t in tokens], np.int64)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        end = np.cumsum(size)
        self.hash = PerfectHash(Hasher(data).of(end - size, end))
        self.id_at = np.zeros(len(tokens), np.uint32)
        self.id_at[self.hash.slot_of] = ids
        self.size = np.zeros(int(ids.max()) + 1, np.int64)
        self.size[ids] = size
        self.first = np.zeros(len(self.size), np.int64)
        self.first[ids] = end - size
        self.data, self.view = data, blocks(data)
        self.misses = IdTable()

    def merge_slices(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, ids in a row) of slices of ``data``."""
        raw = data.tobytes()
        return flattened([merge_piece(raw[a:b], self.ranks) for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in a row, and where each document's ids begin (plus the end)."""
        start = pre_tokens(data, offsets)
        size = np.diff(np.append(start, len(data)))
        hasher = Hasher(data)
        h = hasher.of(start, start + size)
        slot = self.hash.find(h)
        found = np.flatnonzero(slot >= 0)
        token = self.id_at[slot[found]]
        same = self.size[token] == size[found]
        same[same] = same_slices(self.view, self.first[token[same]], hasher.at, start[found[same]], size[found[same]])
        slot[found[~same]] = -1
        miss = np.flatnonzero(slot < 0)
        count = np.ones(len(start), np.int64)
        if len(miss):
            a, n = start[miss], size[miss]
            held = self.misses.slots(hasher, h[miss], a, n, lambda new: self.merge_slices(data, a[new], n[new]))
            count[miss] = self.misses.count[held]
        to = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(int(to[-1]), np.uint32)
        hit = np.flatnonzero(slot >= 0)
        out[to[hit]] = self.id_at[slot[hit]]
        if len(miss):
            out[spread(count[miss], to[miss])] = self.misses.flat[spread(count[miss], self.misses.start[held])]
        return out, to[np.searchsorted(start, offsets)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids in a row, and the byte position after each id (from 0)."""
        size = self.size[ids]
        return self.data[spread(size, self.first[ids])], np.concatenate(([0], np.cumsum(size)))


_made: dict[str, ByteBPE] = {}


def bpe(path: str) -> ByteBPE:
    """One instance per process and vocabulary."""
    if path not in _made:
        _made[path] = ByteBPE(load_ranks(path))
    return _made[path]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                ids, at = model.encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) for every row of ids; null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            column = batch.column(1)
            out = [model.decode(np.asarray(x.values, np.int64))[0].tobytes() if x.is_valid else b"" for x in column]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass; one row of counts and digests per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                ids, at = model.encode(data, offsets)
                text, ends = model.decode(ids)
                raw_ids, raw_text = memoryview(ids.astype("<u4").tobytes()), memoryview(text.tobytes())
                cut = (at * 4).tolist()
                byte = ends[at].tolist()
                digest = [hashlib.sha256(raw_ids[a:b]).hexdigest() for a, b in zip(cut, cut[1:], strict=False)]
                back = [hashlib.sha256(raw_text[a:b]).hexdigest() for a, b in zip(byte, byte[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(digest), pa.array(back)],
                    [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
