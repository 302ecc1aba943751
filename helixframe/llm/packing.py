"""Lexical retrieval packing into fixed windows.

Documents are tokenised once. Full windows are cut from long documents; the
rests are packed by BM25 over token ids, with document frequencies and the mean
length of the whole corpus (tables bounded by the vocabulary).

The inverted index is sharded by content, so that related rests lie in one
shard whatever the size of the corpus. A rest has ``KEYS`` keys, each the least
hash of its runs of ``GRAM`` ids under another function, so two rests share a
key with a probability that is the share of runs they have in common.
Of its keys a rest goes by the rarest that another rest has too, counted over
the corpus (else by its first), and rests are range-partitioned by key and row into shards of
about ``SHARD_DOCS``, so groups of copies of any size are split.

In a shard each seed is scored against all documents (a matrix product for
frequent terms, postings for the others). Its window is filled with its best
unused neighbours, as far as any shares a term with it, and then with the next
unused documents; the last one is cut to fit and its rest goes back to the pool, so
only the last window of a shard is padded. The work is in proportion to the corpus:
documents outside a seed's shard are not its neighbours (tests measure how many
near copies meet; README has figures).

Null or empty texts give the end id alone. Repeated rows are packed as separate
documents. Null ids are packed like others. An empty table gives an empty
result. Extra columns are ignored. Texts of any length are packed whole.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.byte_bpe import ByteBPE, IdTable
from helixframe.llm.store import release, small_batches, stash, tidy
from helixframe.llm.textops import binaries, chunks, mix
from helixframe.llm.token_store import id_type

WINDOW = 2048
SHARD_DOCS = 2048  #: rests of an index, about
KEYS, GRAM = 6, 4
DENSE_TERMS = 1024
_TILE = 32  #: seeds scored at a time
_NEAR = 64  #: neighbours sorted first; the others follow where these leave room
K1, B = 1.2, 0.75
_LONG_PIECE = 24
#: Pre-tokens outside the vocabulary that a worker remembers.
KEEP_MISSES = 1 << 18


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairTable:
    """Numbers of pairs of ids, by open addressing; ``NONE`` for other pairs."""

    NONE, BITS = 1 << 30, 17

    def __init__(self, pairs: np.ndarray):
        self.bits = max(self.BITS, len(pairs).bit_length() + 1)
        self.key, self.number = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE, np.int32)
        left, at = np.arange(len(pairs)), self._at(pairs)
        while len(left):
            free = self.key[at] < 0
            self.key[at[free]] = pairs[left[free]]
            out = self.key[at] == pairs[left]
            self.number[at[out]] = left[out]
            left, at = left[~out], (at[~out] + 1) & ((1 << self.bits) - 1)

    def _at(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        at = self._at(key)
        have, out = self.key[at], self.number[at]
        other = np.flatnonzero(have != key)
        out[other] = self.NONE
        other = other[have[other] >= 0]
        while len(other):
            at[other] = (at[other] + 1) & ((1 << self.bits) - 1)
            have = self.key[at[other]]
            same = have == key[other]
            out[other[same]] = self.number[at[other[same]]]
            other = other[~same & (have >= 0)]
        return out


class MergeBPE(ByteBPE):
    """A tokenizers byte-level BPE file; distinct misses of a chunk are merged together, a step for all at once."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = held["model"]["vocab"]
        super().__init__({to_bytes(t): i for t, i in vocab.items()})
        self.special = [x["content"].encode() for x in held["added_tokens"]]
        merges = [m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"]]
        self.width = max(vocab.values()) + 1
        self.pairs = PairTable(np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64))
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.byte_pairs = self.pair_ranks(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)).reshape(256, 256)
        self.misses = IdTable(KEEP_MISSES)

    @cached_property
    def tokenizer(self):
        """The library's own, for texts that hold the string of a special token."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.pairs.find(left.astype(np.int64) * self.width + right)

    def merge_slices(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(start), np.int64)
        flat, at = np.zeros(int(size.sum()), np.uint32), np.cumsum(size) - size  # a slice has no more ids than bytes
        short = np.flatnonzero(size <= _LONG_PIECE)
        for k in np.flatnonzero(size > _LONG_PIECE).tolist():
            ids = self._by_library(data[start[k] : start[k] + size[k]].tobytes())
            counts[k] = len(ids)
            flat[at[k] : at[k] + len(ids)] = ids
        raw = data[_flat(start[short], size[short])]
        count = size[short]
        ids, piece = self.byte_id[raw], np.repeat(short.astype(np.int32), count)
        none = PairTable.NONE
        rank = np.full(len(ids), none, np.int32)
        inside = np.flatnonzero(piece[1:] == piece[:-1])
        rank[inside] = self.byte_pairs[raw[inside], raw[inside + 1]]
        while len(ids):
            first = np.cumsum(count) - count
            least = np.minimum.reduceat(rank, first)
            over = least == none
            if over.any():
                some, n, gone = piece[first[over]], count[over], np.repeat(over, count)
                counts[some] = n
                flat[_flat(at[some], n)] = ids[gone]
                ids, piece, rank, least, count = ids[~gone], piece[~gone], rank[~gone], least[~over], count[~over]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, count))
            hit = hit[np.concatenate(([True], piece[hit][1:] != piece[hit][:-1]))]  # the leftmost of each piece
            ids[hit] = self.made[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            at_kept = hit - np.arange(len(hit))  # each piece before has lost one
            ids, piece, rank, count = ids[keep], piece[keep], rank[keep], count - 1
            for left in (at_kept, at_kept - 1):
                ok = left[(left >= 0) & (left < len(ids))]
                same = np.zeros(len(ok), bool)
                in_row = ok + 1 < len(ids)
                same[in_row] = piece[ok[in_row]] == piece[ok[in_row] + 1]
                rank[ok[~same]] = none
                ok = ok[same]
                rank[ok] = self.pair_ranks(ids[ok], ids[ok + 1])
        return counts, flat[_flat(at, counts)]

    def _by_library(self, piece: bytes) -> list[int]:
        """A long pre-token: merged by the same rules with a heap."""
        from helixframe.llm.byte_bpe import merge_piece

        return merge_piece(piece, self.ranks)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        if not any(s in raw for s in self.special):
            return super().encode(data, offsets)
        texts = [raw[a:b].decode("utf-8") for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
        lists = [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        at = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        return np.array([i for x in lists for i in x], np.uint32), at


_made: dict[str, MergeBPE] = {}


def model_of(path: str) -> MergeBPE:
    if path not in _made:
        _made[path] = MergeBPE(path)
    return _made[path]


def forget() -> None:
    """A worker that tokenised before needs its tables no more."""
    _made.clear()


def vocabulary(path: str) -> int:
    """Ids of a tokenizers file: one more than the largest."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    return max([*held["model"]["vocab"].values(), *(x["id"] for x in held["added_tokens"])]) + 1


def content_keys(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``KEYS`` rows: the least hash of the runs of ``GRAM`` ids of each slice, of that length or more, that starts at ``first``."""
    ids = ids.astype(np.uint64)
    h = mix((ids[:-1] << np.uint64(32)) + ids[1:] + np.uint64(1))
    h = mix(h[: 1 - GRAM + 1] + h[GRAM - 2 :] * np.uint64(0x9E3779B97F4A7C15))
    h[(first[1:, None] - np.arange(1, GRAM)).ravel()] = ~np.uint64(0)  # runs across slices
    return np.stack([mix(np.minimum.reduceat(_turned(h, j), first) + np.uint64(j)) for j in range(KEYS)]).view(np.int64)


def _turned(h: np.ndarray, j: int) -> np.ndarray:
    """Another order of the same hashes; the last one stays last."""
    return h if not j else np.where(h == ~np.uint64(0), h, (h ^ (h >> np.uint64(7 + 5 * j))) * np.uint64(0x9E3779B97F4A7C15 + 2 * j))


def tokenize(df: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, ids binary of little-endian ids, end id last; _at: task and position in it; keys: of what full windows leave, none if that is less than ``GRAM`` ids)."""
    size = max(vocabulary(path), end_id + 1)
    kind = id_type(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, at_row = model_of(path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                ids, at = model.encode(data, offsets)
                ids = np.insert(ids, at[1:], end_id)
                at = at + np.arange(len(at))
                left = np.diff(at) % window
                some = np.flatnonzero(left >= GRAM)
                keys = np.zeros((0, KEYS), np.int64)
                if len(some):
                    keys = content_keys(ids[_flat(at[1:][some] - left[some], left[some])], np.cumsum(left[some]) - left[some]).T
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(left >= GRAM))) * KEYS, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), binaries(ids.astype(kind), at), pa.array(np.arange(at_row, at_row + hi - lo)), lists],
                    [id_col, "ids", "_at", "keys"],
                )
                at_row += hi - lo

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids binary, _at long, keys array<long>")


def chosen_keys(tokens: DataFrame, n: int) -> DataFrame:
    """(_at, key) of rests that go by another key than their first: the rarest that two to ``SHARD_DOCS`` rests have; ties by place."""
    rows = tokens.select("_at", F.posexplode("keys").alias("j", "key"))
    counts = stash(rows.groupBy("j", "key").agg(F.count("*").alias("n")).where("n > 1"), "packing-keys", narrow=True)
    hot = [r["key"] for r in counts.where(F.col("n") > max(SHARD_DOCS, n * KEYS // 4096)).select("key").collect()]  # 4096 at most
    if hot:
        rows = rows.where(~F.col("key").isin(hot))  # no task gathers the rests of a key that divides nothing
    best = rows.join(counts.where(F.col("n") <= SHARD_DOCS), ["j", "key"]).groupBy("_at").agg(F.min(F.struct("n", "j", "key")).alias("b"))
    out = stash(best.where("b.j > 0").select("_at", "b.key"), "packing-chosen", narrow=True)
    release(counts)
    tidy(tokens.sparkSession)
    return out


def _ids(x: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind)


def document_frequencies(tokens: DataFrame, size: int) -> tuple[int, float, np.ndarray]:
    """Documents, mean length, and in how many documents each id occurs, over the whole corpus."""
    kind = id_type(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen, n, total, last = np.zeros(size, np.int64), 0, 0, np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                ids = _ids(x, kind)
                at = np.arange(len(ids))
                last[ids] = at
                seen[ids[last[ids] == at]] += 1  # each id once, where it is last
                n, total = n + 1, total + len(ids)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([*used, -1, -2], pa.int32()), pa.array([*seen[used], n, total], pa.int64())], ["id", "n"])

    df, n, total = np.zeros(size, np.int64), 0, 0
    for row in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        if row.id == -1:
            n = row.n
        elif row.id == -2:
            total = row.n
        else:
            df[row.id] = row.n
    return n, total / max(n, 1), df


@dataclass(frozen=True)
class Corpus:
    """Statistics of the whole corpus; ``column`` numbers the frequent terms that count, -1 for others."""

    idf: np.ndarray
    mean: float
    column: np.ndarray

    @classmethod
    def of(cls, n: int, mean: float, seen: np.ndarray) -> Corpus:
        idf = np.where(seen > 0, np.log((n - seen + 0.5) / (seen + 0.5)), 0.0)  # 0 or less for terms of half the documents
        often = np.argsort(np.where(idf > 0, -seen, 1), kind="stable")[:DENSE_TERMS]
        often = often[idf[often] > 0]
        column = np.full(len(idf), -1, np.int64)
        column[often] = np.arange(len(often))
        return cls(idf, mean, column)


def _flat(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all slices ``at[k] : at[k] + size[k]``, one after the other."""
    return np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())


class Index:
    """BM25 index of a shard: a matrix over frequent terms, postings of the others."""

    def __init__(self, parts: list[np.ndarray], corpus: Corpus):
        length = np.array([len(x) for x in parts])
        wide = len(corpus.idf) * len(parts) > 1 << 32
        held = np.sort(np.repeat(np.arange(len(parts)) * len(corpus.idf), length).astype(np.uint64 if wide else np.uint32) + np.concatenate(parts))
        first = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
        count = np.diff(np.append(first, len(held)))
        row, term = (x.astype(np.int64) for x in np.divmod(held[first], len(corpus.idf)))
        weight = (corpus.idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length[row] / corpus.mean))).astype(np.float32)
        self.n, col = len(parts), corpus.column[term]
        self.held = np.zeros((int(corpus.column.max(initial=-1)) + 1, self.n), np.float32)
        self.held[col[col >= 0], row[col >= 0]] = weight[col >= 0]
        rare = np.flatnonzero((col < 0) & (corpus.idf[term] > 0))
        self.terms, self.of_row = term[rare], np.searchsorted(row[rare], np.arange(self.n + 1))
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.doc, self.weight, self.at = row[rare], weight[rare], np.searchsorted(term[rare], np.arange(len(corpus.idf) + 1))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Scores of all documents for each of some seeds."""
        out = (self.held[:, rows] > 0).astype(np.float32).T @ self.held
        for i, k in enumerate(rows.tolist()):
            terms = self.terms[self.of_row[k] : self.of_row[k + 1]]
            cut = _flat(self.at[terms], self.at[terms + 1] - self.at[terms])
            out[i] += np.bincount(self.doc[cut], self.weight[cut], self.n).astype(np.float32)
        return out


class Pool:
    """What the driver knows of the documents' rests, and the windows made of them."""

    def __init__(self, left: np.ndarray, window: int):
        self.window, self.left, self.start, self.following, self.spare = window, left, np.zeros(len(left), np.int64), 0, 0
        self.made: list[list[tuple[int, int, int]]] = []

    def put(self, row: list, room: int, k: int) -> int:
        """Put document ``k`` into a window as far as it fits; the room left."""
        n = min(room, int(self.left[k]))
        row.append((k, int(self.start[k]), n))
        self.start[k] += n
        self.left[k] -= n
        return room - n

    def upcoming(self, n: int) -> np.ndarray:
        """The next ``n`` free documents."""
        while self.following < len(self.left) and not self.left[self.following]:
            self.following += 1
        lo, found, out = self.following, 0, []
        while lo < len(self.left) and found < n:
            out.append(lo + np.flatnonzero(self.left[lo : lo + (1 << 16)])[: n - found])
            found, lo = found + len(out[-1]), lo + (1 << 16)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def fill(self, row: list, room: int) -> int:
        """No free document shares a term with the seed: the next unused ones. The room left."""
        while room and self.spare < len(self.left):
            if self.left[self.spare]:
                room = self.put(row, room, self.spare)
            else:
                self.spare += 1
        return room

    def close(self, windows: list[tuple[list, int]]) -> None:
        """Windows with room when nothing is free: the last are dealt to the first, so that one at most stays short."""
        while windows:
            row, room = windows.pop(0)
            while room and windows:
                other, free = windows.pop()
                k, start, n = other.pop()
                part = min(room, n)
                row.append((k, start, part))
                room -= part
                if part < n:
                    other.append((k, start + part, n - part))
                if other:
                    windows.append((other, free + part))
            self.made.append(row)


def ranked(score: np.ndarray, free: np.ndarray) -> Iterator[int]:
    """Free documents that share a term with the seed, by falling score; ties by place."""
    found = np.flatnonzero((score > 0) & free)
    if len(found) > _NEAR:
        least = np.partition(score[found], len(found) - _NEAR)[len(found) - _NEAR]
        near = found[score[found] >= least]
        yield from near[np.argsort(-score[near], kind="stable")].tolist()
        found = found[score[found] < least]
    yield from found[np.argsort(-score[found], kind="stable")].tolist()


def windows_of(parts: list[np.ndarray], corpus: Corpus, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) that hold every token of a shard's rests once."""
    pool, index, short, scored = Pool(np.array([len(x) for x in parts], np.int64), window), Index(parts, corpus), [], {}
    while len(free := pool.upcoming(1)):
        seed = int(free[0])
        if seed not in scored:
            rows = pool.upcoming(_TILE)
            scored = dict(zip(rows.tolist(), index.scores(rows), strict=True))
        row: list = []
        room = pool.put(row, window, seed)
        if room:
            for k in ranked(scored[seed], pool.left > 0):
                room = pool.put(row, room, k)
                if not room:
                    break
        if room:
            room = pool.fill(row, room)
        if room:
            short.append((row, room))
        else:
            pool.made.append(row)
    pool.close(short)
    return pool.made


def pack(df: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece; see the module's head."""
    spark = df.sparkSession
    small_batches(spark)
    tokens = stash(tokenize(df, path, end_id, id_col, text_col, window), "packing-ids", codec="zstd")
    size = max(vocabulary(path), end_id + 1)
    kind = id_type(size)
    n, mean, seen = document_frequencies(tokens, size)
    tidy(spark)
    held = spark.sparkContext.broadcast(Corpus.of(n, mean, seen))  # vocabulary-bounded
    # joined by broadcast or shuffle as its size demands; rests of one key, copies above all, are dealt by row
    keyed = tokens.join(chosen_keys(tokens, n), "_at", "left").select(id_col, "ids", "_at", F.coalesce("key", F.get("keys", 0), F.lit(0)).alias("key"))
    order = [F.col("key"), F.xxhash64("_at")]
    dealt = keyed.repartitionByRange(max(1, -(-n // SHARD_DOCS)), *order).sortWithinPartitions(*order).select(id_col, "ids")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own = TaskContext.get().partitionId() + 1 << 36
        parts: list[np.ndarray] = []
        of: list[tuple] = []
        rows: list[tuple] = []

        def add(k: object, ids: np.ndarray, start: int, total: int, sequence: int, at: int) -> None:
            rows.append((k, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, at))

        def packed() -> None:
            nonlocal own
            for made in windows_of(parts, held.value, window) if parts else []:
                at = 0
                for i, start, length in made:
                    k, whole, total = of[i]
                    add(k, parts[i][start : start + length], whole + start, total, own, at)
                    at += length
                own += 1
            parts.clear()
            of.clear()

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, key_type if i == 0 else pa.int64()) for i, c in enumerate(columns)], names)

        for batch in batches:
            key_type = batch.column(0).type
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = _ids(x, kind)
                whole = len(ids) - len(ids) % window
                for at in range(0, whole, window):
                    add(k, ids[at : at + window], at, len(ids), own, 0)
                    own += 1
                if whole < len(ids):
                    parts.append(ids[whole:].copy())
                    of.append((k, whole, len(ids)))
                if len(parts) == 2 * SHARD_DOCS:  # the ranges are of sampled, not of equal sizes
                    packed()
                if len(rows) >= 8192:
                    yield out()
        packed()
        if rows:
            yield out()

    return dealt.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
