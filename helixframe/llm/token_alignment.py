"""Alignment of two tokenizers over one corpus, through a dictionary of groups.

Both tokenizers cover the bytes of a space and the text. Where a token of each
ends at the same byte, a group ends: some A ids against some B ids. Texts are
made of few distinct groups, so the corpus-wide work is done on these:

1. Documents are cut into blocks (about ``BLOCK_BYTES`` of text, whole documents).
   A block is one row: per document the numbers that it alone decides and its
   groups as (number in the block's dictionary, times). The dictionary's rows
   are (block, number, group, times); a group is named by its ids, not a hash.
2. Distinct groups and their times over the corpus are interned. Each is
   expanded into links once: an A and a B token are linked where their bytes
   overlap, so links are the stretches between all ends of a group.
3. A pair's count is the sum of its groups' times. Counts go back to the links
   and are summed by group, then join the dictionaries by group and the blocks
   by number. No row is made for a token or link of a document.

A ids of byte-level BPE come from a table of pre-tokens, B ids from a table of
stretches from one run of spaces to the next: no piece of the model holds a
space behind another letter (checked when the model is read), so merges don't
cross there.

Null and empty texts, and texts whose joined bytes of A or of B differ from
space+text, have no tokens: zeros and an empty digest. Every row is a document
of its own, so null and repeated ids keep their rows. An empty table gives an
empty result; extra columns are ignored. A text of any length is read whole and
lies in one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.byte_bpe import ByteBPE, IdTable, spread
from helixframe.llm.packing import model_of
from helixframe.llm.store import release, small_batches, stash, tidy
from helixframe.llm.textops import Hasher, chunks

BLOCK_BYTES = 8 << 20
#: Entries of a task's tables, emptied between blocks when they hold more.
KEEP = 1 << 18
#: In place of the ids of a stretch that the pieces don't spell.
_BAD = np.uint32(0xFFFFFFFF)
_SPACE_LETTER = "▁"


class Pieces:
    """A sentencepiece BPE model behind a table of stretches."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(_SPACE_LETTER in p.lstrip(_SPACE_LETTER) for p in pieces):
            raise ValueError("the model has pieces that go on behind a space")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE_LETTER, " ").encode() for i, p in enumerate(pieces)]
        self.size = np.array([*map(len, self.bytes)], np.int64)
        self.space = self.model.piece_to_id(_SPACE_LETTER)
        self.table = IdTable(KEEP)

    def ids(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of stretches that begin with a space, which the model adds itself."""
        found = self.model.encode([x[1:].decode() for x in stretches], num_threads=1)
        lists = []
        for x, ids in zip(stretches, found, strict=True):
            ids = ids or [self.space]
            lists.append(ids if b"".join(map(self.bytes.__getitem__, ids)) == x else [_BAD])
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return counts, np.fromiter((i for ids in lists for i in ids), np.uint32, int(counts.sum()))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that each begin with a space, and where each one's begin (plus the end); ``_BAD`` marks texts that aren't spelled."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = data == 0x20
        cut[1:] &= data[:-1] != 0x20
        raw = data.tobytes()
        if _SPACE_LETTER.encode() in raw:  # the model takes it for a space, so such texts are one stretch
            for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                if _SPACE_LETTER.encode() in raw[a:b]:
                    cut[a:b] = False
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, len(data)))
        hasher = Hasher(data)
        held = self.table.slots(hasher, hasher.of(start, start + size), start, size, lambda new: self.ids([raw[start[i] : start[i] + size[i]] for i in new.tolist()]))
        count = self.table.count[held]
        return self.table.flat[spread(count, self.table.start[held])], np.concatenate(([0], np.cumsum(count)))[np.searchsorted(start, offsets)]


_made: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _made:
        _made[path] = Pieces(path)
    return _made[path]


def with_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that is not empty."""
    some = np.diff(offsets) > 0
    return np.insert(data, offsets[:-1][some], 0x20), offsets + np.concatenate(([0], np.cumsum(some)))


class Groups:
    """The groups of a chunk of texts: A ids and B ids in a row, and the last of each in every group."""

    def __init__(self, a: ByteBPE, b: Pieces, data: np.ndarray, offsets: np.ndarray):
        data, offsets = with_space(data, offsets)
        self.b, self.b_at = b.encode(data, offsets)
        odd = np.flatnonzero(self.b == _BAD)
        if len(odd):
            good = np.ones(len(offsets) - 1, bool)
            good[np.searchsorted(self.b_at, odd, "right") - 1] = False
            size = np.where(good, np.diff(offsets), 0)
            data = data[spread(size, offsets[:-1])]
            offsets = np.concatenate(([0], np.cumsum(size)))
            self.b, self.b_at = b.encode(data, offsets)
        self.a, self.a_at = ByteBPE.encode(a, data, offsets)  # special tokens' strings are plain text
        a_end, b_end = np.cumsum(a.size[self.a]), np.cumsum(b.size[self.b])
        at = np.searchsorted(b_end, a_end)
        both = np.flatnonzero(b_end[np.minimum(at, len(b_end) - 1)] == a_end) if len(a_end) else np.zeros(0, np.int64)
        self.n_a = np.diff(np.concatenate(([-1], both)))
        self.n_b = np.diff(np.concatenate(([-1], at[both])))
        self.at = np.searchsorted(both, self.a_at)  # first group of each text, and the end

    def keys(self, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All groups as bytes in a row, with starts and sizes: the number of A ids in two words, A ids, B ids."""
        size = 2 + self.n_a + self.n_b
        at = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), kind)
        out[at], out[at + 1] = self.n_a & 0xFFFF, self.n_a >> 16
        out[spread(self.n_a, at + 2)] = self.a
        out[spread(self.n_b, at + 2 + self.n_a)] = self.b
        width = out.itemsize
        return out.view(np.uint8), at * width, size * width


def word_kind(*sizes: int) -> str:
    """Type of a word that holds ids below all ``sizes``."""
    return "<u2" if max(sizes) <= 1 << 16 else "<u4"


def unpacked(key: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A ids and B ids of a group."""
    words = np.frombuffer(key, kind)
    n = int(words[0]) | int(words[1]) << 16
    return words[2 : 2 + n], words[2 + n :]


def _name(key: bytes, kind: str) -> bytes:
    a, b = unpacked(key, kind)
    return b"%s|%s" % (",".join(map(str, a.tolist())).encode(), ",".join(map(str, b.tolist())).encode())


_WIDE = pa.large_binary()


def blocks(df: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a block: documents with their numbers and groups, and the block's dictionary."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, table, names = model_of(path_a), pieces_of(path_b), IdTable(1 << 62), []
        kind = word_kind(len(a.size), len(b.size))
        block, room = TaskContext.get().partitionId() << 32, block_bytes
        ids: list = []
        numbers: list[np.ndarray] = []
        digests: list[str] = []
        slots: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, room
            held, codes = np.unique(np.concatenate(slots), return_inverse=True)
            per = np.concatenate(numbers)
            doc = np.repeat(np.arange(len(per)), per[:, 2])
            own, times = np.unique(doc * max(len(held), 1) + codes, return_counts=True)
            at = np.concatenate(([0], np.cumsum(np.bincount(own // max(len(held), 1), minlength=len(per)))))
            freq = np.bincount(codes, minlength=len(held))
            text, text_at = table.text.tobytes(), table.text_at[held].tolist()
            keys = [text[s : s + n] for s, n in zip(text_at, table.size[held].tolist(), strict=True)]
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(per)], pa.int32()), pa.chunked_array(ids).combine_chunks()),
                    pa.array([per.astype("<i8").tobytes()], pa.binary()), one(digests, pa.string()),
                    pa.array([at.astype("<i8").tobytes()], pa.binary()), pa.array([(own % max(len(held), 1)).astype("<u4").tobytes()], pa.binary()), pa.array([times.astype("<u4").tobytes()], pa.binary()),
                    one(keys, pa.binary()), one(freq, pa.int64()),
                ],
                ["block", "ids", "numbers", "digests", "at", "codes", "times", "keys", "freq"],
            )
            block, room = block + 1, block_bytes
            for x in (ids, numbers, digests, slots):
                x.clear()
            if table.n > KEEP:
                table.clear()
                names.clear()
            return row

        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                found = Groups(a, b, data, offsets)
                raw, start, size = found.keys(kind)
                hasher = Hasher(raw)
                none = lambda new: (np.zeros(len(new), np.int64), np.zeros(0, np.uint32))
                own = table.slots(hasher, hasher.of(start, start + size), start, size, none)
                text = table.text
                for k in range(len(names), table.n):
                    names.append(_name(text[table.text_at[k] : table.text_at[k] + table.size[k]].tobytes(), kind))
                flat = list(map(names.__getitem__, own.tolist()))
                at = found.at.tolist()
                digests.extend(hashlib.sha256(b";".join(flat[x:y])).hexdigest() if y > x else "" for x, y in zip(at, at[1:], strict=False))
                numbers.append(np.stack((np.diff(found.a_at), np.diff(found.b_at), np.diff(found.at)), 1))
                slots.append(own)
                ids.append(batch.column(0).slice(lo, hi - lo))
                room -= len(data)
                if room <= 0:
                    yield flush()
        if ids:
            yield flush()

    out = f"block long, ids array<{id_type}>, numbers binary, digests array<string>, at binary, codes binary, times binary, keys array<binary>, freq array<long>"
    return df.select(id_col, text_col).mapInArrow(run, out)


def expand(groups: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(key, freq, a, b): the links of each distinct group (key, freq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a, size_b = model_of(path_a).size, pieces_of(path_b).size
        kind = word_kind(len(size_a), len(size_b))
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                lists = [unpacked(x, kind) for x in part.column(0).to_pylist()]
                if not lists:
                    continue
                a, b = (np.concatenate([x[k] for x in lists]).astype(np.int64) for k in (0, 1))
                a_end, b_end = np.cumsum(size_a[a]), np.cumsum(size_b[b])
                ends = np.union1d(a_end, b_end)
                last = np.cumsum([len(x) for x, _ in lists]) - 1
                group = np.searchsorted(a_end[last], ends)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(group)), part.column(1).take(pa.array(group)), pa.array(a[np.searchsorted(a_end, ends)], pa.int32()), pa.array(b[np.searchsorted(b_end, ends)], pa.int32())],
                    ["key", "freq", "a", "b"],
                )

    return groups.mapInArrow(run, "key binary, freq long, a int, b int")


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, n): how many links of the corpus hold the pair."""
    return links.groupBy("a", "b").agg(F.sum("freq").alias("n"))


def group_scores(links: DataFrame) -> DataFrame:
    """(key, n_best, count_sum) of each group."""
    pairs = stash(pair_counts(links), "align-pairs", narrow=True)
    best = pairs.groupBy("b").agg(F.max("n").alias("most"))
    scored = links.join(pairs.join(best, "b"), ["a", "b"])
    out = stash(scored.groupBy("key").agg(F.sum(F.when(F.col("n") == F.col("most"), 1).otherwise(0)).alias("n_best"), F.sum("n").alias("count_sum")), "align-scores", narrow=True)
    release(pairs)
    return out


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row; see the module's head."""
    spark = df.sparkSession
    small_batches(spark)
    held = stash(blocks(df, path_a, path_b, id_col, text_col, block_bytes), "align-blocks", codec="zstd")
    entries = held.select("block", F.posexplode(F.arrays_zip("keys", "freq")).alias("code", "e")).select("block", "code", "e.keys", "e.freq").withColumnRenamed("keys", "key")
    groups = stash(entries.groupBy("key").agg(F.sum("freq").alias("freq")), "align-groups", narrow=True)
    links = stash(expand(groups.select("key", "freq"), path_a, path_b), "align-links")
    scores = group_scores(links)
    release(groups, links)
    tidy(spark)
    back = entries.select("block", "code", "key").join(scores, "key").select("block", "code", "n_best", "count_sum")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], x.type) for x in out_schema(left)], schema=out_schema(left))
        one = lambda c, kind: np.frombuffer(left.column(c)[0].as_buffer(), kind)
        numbers, at, codes, times = one("numbers", "<i8").reshape(-1, 3), one("at", "<i8"), one("codes", "<u4"), one("times", "<u4").astype(np.int64)
        n_a, n_b, n_groups = numbers.T
        sums = []
        code = right.column("code").to_numpy()
        for name in ("n_best", "count_sum"):
            by_code = np.zeros(len(code), np.int64)
            by_code[code] = right.column(name).to_numpy()
            total = np.concatenate(([0], np.cumsum(by_code[codes] * times)))
            sums.append(total[at[1:]] - total[at[:-1]])
        columns = [left.column("ids").combine_chunks().flatten(), n_a, n_b, n_groups, n_a + n_b - n_groups, *sums, left.column("digests").combine_chunks().flatten()]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], schema=out_schema(left))

    def out_schema(left: pa.Table) -> pa.Schema:
        return pa.schema([(id_col, left.schema.field("ids").type.value_type), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])

    docs = held.select(F.col("block").alias("own"), "ids", "numbers", "digests", "at", "codes", "times")
    id_type = df.schema[id_col].dataType.simpleString()
    return docs.groupBy("own").cogroup(back.groupBy("block")).applyInArrow(run, f"`{id_col}` {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def token_groups(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, groups: the groups of every text in order, each with its A ids and its B ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = model_of(path_a), pieces_of(path_b)
        listed = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                g = Groups(a, b, data, offsets)
                sides = [listed(np.concatenate(([0], np.cumsum(n))), pa.array(ids.astype(np.int32))) for n, ids in ((g.n_a, g.a), (g.n_b, g.b))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), listed(g.at, pa.StructArray.from_arrays(sides, ["a", "b"]))], [id_col, "groups"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, groups array<struct<a: array<int>, b: array<int>>>")
