"""Token ids in a compact file format: frequency-ranked ids, byte-aligned variable length, separate control bytes.

Texts are encoded once; the corpus-wide id counts (a table bounded by the
vocabulary) give each id its rank, so frequent ids take one byte. A store is a
folder that describes itself: ``ranks`` holds the id of each rank, ``blocks`` the
documents, in ascending id order within ascending shards. A block has a header
(mark, version, numbers of documents and of ids), the documents' keys, and a
payload: the documents' lengths, then their ranks, both as 2-bit byte lengths
in control bytes (four numbers each) apart from the data bytes, decoded by
table lookups over control bytes. Both parts are Parquet tables, so Spark
commits them atomically and any store Spark reads will do.

Null or empty texts give the end id alone. Null ids sort first; rows of one id
come in the order of their ids' hash. Repeated rows are kept. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.byte_bpe import IdTable, flattened, spread
from helixframe.llm.store import ROW_GROUP, new_path, release, small_batches, stash, track
from helixframe.llm.textops import Hasher, binaries, chunks, give_back, words

MAGIC, VERSION = 0x31425648, 2
BLOCK_TOKENS = 1 << 19
SHARD_TOKENS = 1 << 24
KEEP_WORDS = 500_000
_BATCH, _ROW = 1 << 13, 1 << 10

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{}~")] = True  # without |, which ends the special tokens' names

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(values: np.ndarray) -> bytes:
    """Control bytes and data bytes of numbers below 2**32."""
    values = values.astype(np.uint32)
    n = len(values)
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes() + raw[np.arange(4) <= code[:, None]].tobytes()


def unpack(payload: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """``n`` numbers from ``at`` on, and where they end."""
    n_control = -(-n // 4)
    size = _LENGTHS[np.frombuffer(payload, np.uint8, n_control, at)].reshape(-1)[:n]
    data = np.frombuffer(payload, np.uint8, offset=at + n_control)
    end = np.cumsum(size)
    from_ = end - size
    out = data[from_].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[more] |= data[from_[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out, at + n_control + int(end[-1] if n else 0)


def block(sizes: list[int], ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(header, payload) of documents of these lengths."""
    return np.array([MAGIC, VERSION, len(sizes), len(ranks)], "<u4").tobytes(), pack(np.array(sizes)) + pack(ranks)


def unblock(header: bytes, payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, ranks) of a block."""
    magic, version, n_documents, n_ids = np.frombuffer(header, "<u4").tolist()
    if magic != MAGIC or version != VERSION:
        raise ValueError(f"not a token block of version {VERSION}")
    sizes, at = unpack(payload, n_documents)
    return sizes.astype(np.int64), unpack(payload, n_ids, at)[0]


class WordTokenizer:
    """The tokenizers library behind a table of white-space words.

    The tokenizer lower-cases, drops white space, and splits there and between an
    ASCII letter and punctuation, so a text's ids are those of these units in a
    row; each distinct unit is encoded once while the table holds it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.table = IdTable(KEEP_WORDS)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, end, _ = words(data, offsets)
        if len(data) > 1:
            inside = _LETTER[data[:-1]] & _MARK[data[1:]]
            inside[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))] - 1] = False
            cut = np.flatnonzero(inside) + 1
            start, end = np.sort(np.concatenate((start, cut))), np.sort(np.concatenate((end, cut)))
        return start, end, np.searchsorted(start, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end, at = self.units(data, offsets)
        special = b"<|" in data.tobytes()  # such strings may be special tokens, in lower case only
        hasher = Hasher(data, lower=not special)
        raw = data.tobytes()

        def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            first, size = start[new], (end - start)[new]
            counts, at, flat, used = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [np.zeros(0, np.uint32)], 0

            def take(some: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
                nonlocal used
                counts[some] = n
                at[some] = used + np.cumsum(n) - n
                flat.append(ids)
                used += len(ids)

            # Latin letters only: one pre-token, so one word end
            ascii_ = np.logical_and.reduceat(_LETTER[data[spread(size, first)]], np.cumsum(size) - size) if len(new) else np.zeros(0, bool)
            simple = ascii_.copy()
            texts = {k: raw[first[k] : first[k] + size[k]].decode() for k in np.flatnonzero(~ascii_).tolist()}
            simple[[k for k, t in texts.items() if t.isalpha() and max(t) < "\u0250" and "\u0130" not in t]] = True
            plain = np.flatnonzero(simple)
            for lo in range(0, len(plain), _BATCH):
                some = plain[lo : lo + _BATCH]
                joined = np.full(int(size[some].sum()) + len(some), 0x20, np.uint8)
                joined[spread(size[some], np.cumsum(size[some] + 1) - size[some] - 1)] = data[spread(size[some], first[some])]
                cut = np.append(np.cumsum(size[some] + 1)[_ROW - 1 : -1 : _ROW], len(joined)).tolist()
                found = self.tokenizer.encode_batch_fast([joined[a:b].tobytes().decode() for a, b in zip([0, *cut], cut, strict=False)], add_special_tokens=False)
                ids = np.concatenate([np.array(x.ids, np.uint32) for x in found])
                take(some, ids, np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0))
            rest = np.flatnonzero(~simple)
            for lo in range(0, len(rest), _BATCH):
                some = rest[lo : lo + _BATCH]
                n, ids = flattened([x.ids for x in self.tokenizer.encode_batch_fast([texts[k] for k in some.tolist()], add_special_tokens=False)])
                take(some, ids, n)
            return counts, np.concatenate(flat)[spread(counts, at)]

        held = self.table.slots(hasher, hasher.of(start, end), start, end - start, make)
        count = self.table.count[held]
        return self.table.flat[spread(count, self.table.start[held])], np.concatenate(([0], np.cumsum(count)))[at]


_made: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _made:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _made[path] = WordTokenizer(path)
    return _made[path]


def forget() -> None:
    """A worker that encoded before needs its tables no more."""
    _made.clear()
    give_back()


def encode(df: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, n_tokens): little-endian unsigned ids, 2 bytes each if the vocabulary allows (else 4), end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_tokenizer(path)
        kind = id_type(model.tokenizer.get_vocab_size())
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                ids, at = model.encode(data, offsets)
                ids = np.insert(ids, at[1:], end_id).astype(kind)
                at = at + np.arange(len(at))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), binaries(ids, at), pa.array(np.diff(at))], [id_col, "ids", "n_tokens"])
            give_back()  # Arrow's allocator keeps over 100 MB otherwise, the C library's 40 MB

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids binary, n_tokens long")


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def runs(column: pa.Array, kind: str) -> Iterator[np.ndarray]:
    """The ids of all rows of a binary column, ``BLOCK_TOKENS`` at a time."""
    column = column.cast(pa.large_binary())
    _, offsets, values = column.buffers()
    at, end = np.frombuffer(offsets, np.int64)[[column.offset, column.offset + len(column)]].tolist() if len(column) else (0, 0)
    ids = np.frombuffer(values, kind, (end - at) // np.dtype(kind).itemsize, at) if end > at else np.zeros(0, kind)
    for at in range(0, len(ids), BLOCK_TOKENS):
        yield ids[at : at + BLOCK_TOKENS]


def count_ids(encoded: DataFrame, vocabulary: int) -> np.ndarray:
    """Corpus-wide count of every id (array of the vocabulary's size)."""
    kind = id_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for ids in runs(batch.column(0), kind):
                total += np.bincount(ids, minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for row in encoded.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        counts[row.id] = row.n
    return counts


def write(df: DataFrame, path: str, vocabulary: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", target: str | None = None) -> str:
    """Encode and write a store; returns its folder."""
    spark = df.sparkSession
    target = target or track(spark, new_path(spark, "token-store"))
    encoded = stash(encode(df, path, end_id, id_col, text_col), "token-ids")
    counts = count_ids(encoded, vocabulary)
    by_rank = np.argsort(-counts, kind="stable").astype("<u4")
    rank = np.empty(vocabulary, np.uint32)
    rank[by_rank] = np.arange(vocabulary, dtype=np.uint32)
    head = pa.table([pa.array([VERSION], pa.int32()), pa.array([vocabulary], pa.int32()), pa.array([by_rank.tobytes()], pa.binary())], ["version", "vocabulary", "ids"])
    spark.createDataFrame(head).coalesce(1).write.parquet(f"{target}/ranks")  # rows of Python objects would start workers of their own, which stay
    kind = id_type(vocabulary)
    shards = max(1, -(-int(counts.sum()) // SHARD_TOKENS))
    table = spark.sparkContext.broadcast(rank)  # vocabulary-bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shard, number, waiting = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        keys: list = []

        def flush() -> pa.RecordBatch:
            header, payload = block([len(x) for x in held], table.value[np.concatenate(held)])
            columns = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([keys], pa.list_(key_type)), pa.array([header], pa.binary()), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "block", "keys", "header", "payload"])

        for batch in batches:
            key_type = batch.column(0).type
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append(np.frombuffer(raw.as_buffer(), kind).copy())
                keys.append(key)
                waiting += len(held[-1])
                if waiting >= BLOCK_TOKENS:
                    yield flush()
                    held, keys, waiting, number = [], [], 0, number + 1
        if held:
            yield flush()

    key = df.schema[id_col].dataType.simpleString()
    order = [F.col(id_col).asc_nulls_first(), F.col("_tie")]  # equal ids needn't meet in one task
    ordered = encoded.select(id_col, "ids", F.xxhash64("ids").alias("_tie")).repartitionByRange(shards, *order).sortWithinPartitions(*order).select(id_col, "ids")
    small_batches(spark)
    ordered.mapInArrow(run, f"shard int, block int, keys array<{key}>, header binary, payload binary").write.option("parquet.block.size", ROW_GROUP).parquet(f"{target}/blocks")
    release(encoded)
    return target


def read(spark: SparkSession, target: str, id_col: str = "doc_id", ids: bool = True) -> DataFrame:
    """Per document, from a store's files alone: id, start, n_tokens, ids_crc32, and with ``ids`` the token ids (array<int>)."""
    ranks = spark.read.parquet(f"{target}/ranks").first()
    if ranks["version"] != VERSION:
        raise ValueError(f"not a token store of version {VERSION}")
    table = spark.sparkContext.broadcast(np.frombuffer(bytes(ranks["ids"]), "<u4"))  # vocabulary-bounded
    blocks = spark.read.parquet(f"{target}/blocks")
    digits = F.hex(F.substring("header", 13, 4))  # the number of ids, its lowest byte first
    n = F.conv(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
    counted = blocks.select("shard", "block", n.alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = counted.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", before(Window.orderBy("shard")).alias("before"))  # a row a shard
    inside = counted.select("shard", "block", before(Window.partitionBy("shard").orderBy("block")).alias("inside"))
    starts = inside.join(shards, "shard").select("shard", "block", (F.col("before") + F.col("inside")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for k in range(batch.num_rows):
                sizes, found = unblock(batch.column(2)[k].as_buffer(), batch.column(3)[k].as_buffer())
                found = table.value[found]
                end = np.cumsum(sizes)
                raw, cut = memoryview(found.tobytes()), np.concatenate(([0], end * 4)).tolist()
                columns = [batch.column(1)[k].values, pa.array(batch.column(0)[k].as_py() + end - sizes), pa.array(sizes), pa.array([zlib.crc32(raw[a:b]) for a, b in zip(cut, cut[1:], strict=False)], pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], end)), pa.int32()), pa.array(found.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    key = blocks.schema["keys"].dataType.elementType.simpleString()
    return blocks.join(starts, ["shard", "block"]).select("start", "keys", "header", "payload").mapInArrow(run, f"`{id_col}` {key}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))
