"""What Python workers hold and do: tables go when they are needed no more, misses are merged without a step a word."""

import cProfile
import gc
import pstats
import random
import tracemalloc
from unittest.mock import MagicMock

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from helixframe.llm import byte_bpe, packing, token_store
from helixframe.llm.textops import Hasher, binaries


@pytest.fixture(autouse=True)
def no_garbage():
    """Else handles of other tests' Spark objects may be freed while calls are counted, and count too."""
    gc.collect()


def test_a_worker_that_counts_ids_drops_the_tokenizer(spark):
    token_store.word_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    batch, seen, encoded = pa.RecordBatch.from_arrays([pa.array([np.array([5, 5, 7], "<u2").tobytes()])], ["ids"]), [], MagicMock()

    def here(run, schema):
        seen.extend(run(iter([batch])))
        return MagicMock()

    encoded.select.return_value.mapInArrow.side_effect = here
    token_store.count_ids(encoded, 49_408)
    assert seen[0].to_pydict() == {"id": [5, 7], "n": [2, 1]} and not token_store._made


def test_misses_are_merged_without_a_step_a_word():
    model = packing.MergeBPE(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    text = " ".join({"".join(rng.choices("qxzjkvw", k=rng.randrange(5, 24))) for _ in range(4000)} | {"q" * 90})
    data = np.frombuffer(text.encode(), np.uint8)
    model.encode(data[:1], np.array([0, 1]))  # makes the table of character classes
    profile = cProfile.Profile()
    ids, _ = profile.runcall(model.encode, data, np.array([0, len(data)]))
    assert ids.tolist() == model.tokenizer.encode(text, add_special_tokens=False).ids
    assert pstats.Stats(profile).total_calls < 6000  # one long word takes a few hundred


def test_a_full_table_keeps_what_is_looked_up_again():
    table, made = byte_bpe.IdTable(1000), []

    def look(numbers):
        data = np.frombuffer(b"".join(b"%06d" % x for x in numbers), np.uint8)
        start, size, hasher = np.arange(len(numbers)) * 6, np.full(len(numbers), 6), Hasher(data)

        def make(new):
            made.extend(numbers[k] for k in new)
            return np.full(len(new), 2), np.array([x for k in new for x in (numbers[k], 7)], np.uint32)

        held = table.slots(hasher, hasher.of(start, start + size), start, size, make)
        assert table.flat[byte_bpe.spread(table.count[held], table.start[held])].tolist() == [x for n in numbers for x in (n, 7)]

    often = list(range(300))
    for k in range(20):
        look(often + list(range(1000 + 200 * k, 1200 + 200 * k)))
    assert len(made) == 300 + 20 * 200 and table.n <= 1500
    look(list(range(9000, 10200)))
    look(list(range(9000, 10200)))
    assert table.n > table.limit
    look(often)  # all were looked up again, so all go
    assert table.n == 300


def test_words_are_encoded_without_a_step_a_word():
    model = token_store.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("aeiKLmnorst", k=rng.randrange(3, 14))) for _ in range(6000)})
    text = " ".join([*words, "stra\u00dfe", "\u0130stanbul", "x1", "don't", "\u65e5\u672c"])
    data, profile = np.frombuffer(text.encode(), np.uint8), cProfile.Profile()
    ids, _ = profile.runcall(model.encode, data, np.array([0, len(data)]))
    assert ids.tolist() == model.tokenizer.encode(text, add_special_tokens=False).ids
    assert pstats.Stats(profile).total_calls < 2000


def test_ids_of_a_sliced_column():
    column = pa.array([np.array(x, "<u2").tobytes() for x in ([1, 2], [], [3], [4, 5, 6])], pa.binary())
    assert [x for part in token_store.runs(column.slice(1, 3), "<u2") for x in part.tolist()] == [3, 4, 5, 6]
    assert not list(token_store.runs(column.slice(1, 1), "<u2")) and not list(token_store.runs(column.slice(0, 0), "<u2"))


def test_a_perfect_hash_is_built_without_a_step_a_bucket():
    rng, profile = np.random.default_rng(6), cProfile.Profile()
    keys = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    found = profile.runcall(byte_bpe.PerfectHash, keys)
    assert sorted(found.slot_of.tolist()) == list(range(len(keys))) and (found.find(keys) == found.slot_of).all()
    assert (found.find(rng.integers(0, 1 << 63, 1000, dtype=np.uint64)) < 0).all()
    assert pstats.Stats(profile).total_calls < 40_000


def test_pairs_are_found_by_their_numbers():
    rng = np.random.default_rng(7)
    pairs = np.unique(rng.integers(0, 1 << 32, 50_000))
    rng.shuffle(pairs)
    table, other = packing.PairTable(pairs), np.setdiff1d(rng.integers(0, 1 << 32, 50_000), pairs)
    assert (table.find(pairs) == np.arange(len(pairs))).all() and (table.find(other) == table.NONE).all()


def test_an_index_counts_terms_by_row(monkeypatch):
    rng = np.random.default_rng(8)
    parts = [rng.integers(0, 50, n).astype("<u2") for n in (1, 30, 200)]
    corpus = packing.Corpus.of(100, 80.0, rng.integers(1, 40, 50))
    monkeypatch.setattr(np, "unique", None)  # sorts a row at a time
    index = packing.Index(parts, corpus)
    for k, ids in enumerate(parts):
        count = np.bincount(ids, minlength=50)
        weight = np.where(count > 0, corpus.idf * count * (packing.K1 + 1) / (count + packing.K1 * (1 - packing.B + packing.B * len(ids) / corpus.mean)), 0)
        often = np.flatnonzero(corpus.column >= 0)
        assert np.allclose(index.held[corpus.column[often], k], weight[often], rtol=1e-5)


def kept_by(run, batch):
    """(bytes of ids that a task gives, bytes that a worker holds more after eight more tasks)."""

    def task():
        return sum(x.column(1).nbytes for x in run(iter([batch])))

    size = task()  # makes the model and fills its table
    tracemalloc.start()
    try:
        task()
        gc.collect()
        before = tracemalloc.get_traced_memory()[0]
        for _ in range(8):
            task()
        gc.collect()
        return size, tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()


def the_run(step, path):
    df, found = MagicMock(), []
    df.select.return_value.mapInArrow.side_effect = lambda run, schema: found.append(run)
    step(df, public_tokenizers.path(path))
    return found[0]


_TEXTS = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([f"row {k} of few words " * 2000 for k in range(60)])], ["doc_id", "text"])


def test_a_worker_keeps_no_ids_that_it_gave():
    size, more = kept_by(the_run(token_store.encode, "word_bpe_49k.json"), _TEXTS)
    assert size > 1_000_000 and more < size // 4


def test_binary_rows_from_buffers():
    values = np.arange(10, dtype="<u2")
    rows = binaries(values, np.array([0, 3, 3, 10]))
    rows.validate(full=True)
    assert rows.equals(pa.array([values[:3].tobytes(), b"", values[3:].tobytes()], pa.binary()))
    assert binaries(values[:0], np.array([0, 0])).to_pylist() == [b""]


def test_a_worker_keeps_no_ids_that_it_packs(monkeypatch):
    here = MagicMock()
    here.get.return_value.partitionId.return_value = 0
    monkeypatch.setattr(packing, "TaskContext", here)
    size, more = kept_by(the_run(packing.tokenize, "byte_bpe_50k.json"), _TEXTS)
    assert size > 1_000_000 and more < size // 4
