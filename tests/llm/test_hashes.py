"""Texts made to share a polynomial hash, and hashes cut to a few bits: results must not change."""

import random

import numpy as np
import public_tokenizers
import pytest

from helixframe.llm import byte_bpe, ngram_join, packing, quality_rules, textops, token_store


def doubled(n, a="a", b="b"):
    """Two strings of ``n`` letters by the doubling pattern (abba baab ...)."""
    x, y = a, b
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


def chunk(texts):
    held = [t.encode() for t in texts]
    return np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])


PAIRS = [doubled(n) for n in (1024, 2048, 4096)]
TEXTS = [t for pair in PAIRS for t in pair] + [f"{x} w {x}\n{y}\n{y}" for x, y in PAIRS] + ["", "a", "ab", "a\0", "a\0\0", "\0"]


def test_hash_tells_slices_apart():
    data, at = chunk(TEXTS)
    h = textops.Hasher(data).of(at[:-1], at[1:])
    assert len(set(h.tolist())) == len(set(TEXTS))
    for size in (7, 8, 20, 33):
        g = textops.grams(data, size)
        raw, seen = data.tobytes(), {}
        assert len(g) == len(raw) - size + 1
        for k, x in enumerate(g.tolist()):
            assert seen.setdefault(x, raw[k : k + size]) == raw[k : k + size]


def test_same_slices():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    view, raw = textops.blocks(data), data.tobytes()
    a, b, size = rng.integers(0, 3900, 3000), rng.integers(0, 3900, 3000), rng.integers(0, 40, 3000)
    b[::3] = a[::3]
    size[1::3] %= 8
    assert textops.same_slices(view, a, view, b, size).tolist() == [raw[x : x + n] == raw[y : y + n] for x, y, n in zip(a, b, size, strict=True)]


@pytest.fixture(params=[64, 6], ids=["whole", "six bits"])
def hashed(request, monkeypatch):
    """Hashes as they are, and cut to a few bits, so that most strings share theirs."""
    if request.param < 64:
        of = textops.Hasher.of
        monkeypatch.setattr(textops.Hasher, "of", lambda self, start, end: of(self, start, end) % np.uint64(1 << request.param))
    return request.param


def mixed():
    rng = random.Random(7)
    vocab = ["alpha", "Beta", "gam", "de", "é", "x1", "o'k", "The", "of", "##", "longerwordthaneight", "<|x|>"]
    return [" ".join(rng.choice(vocab) + rng.choice(["", "s", str(rng.randint(0, 99))]) for _ in range(rng.randrange(80))) for _ in range(30)]


def test_word_tokenizer(hashed):
    model = token_store.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for texts in (TEXTS, mixed(), mixed()):
        ids, at = model.encode(*chunk(texts))
        want = [x.ids for x in model.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want


def cut_misses(model, bits, monkeypatch):
    """The vocabulary's hash stays perfect; look-ups of others are cut."""
    if bits < 64:
        of = textops.Hasher.of
        slots = model.misses.slots
        monkeypatch.setattr(model.misses, "slots", lambda hasher, h, *rest: slots(hasher, h % np.uint64(1 << bits), *rest))
        found = model.hash.find
        monkeypatch.setattr(model.hash, "find", lambda h: np.where(found(h) < 0, (h % np.uint64(model.hash.n)).astype(np.int64), found(h)))
        assert of


@pytest.mark.parametrize("bits", [64, 6])
def test_byte_bpe(bits, monkeypatch):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    model = byte_bpe.ByteBPE(byte_bpe.load_ranks(path))
    cut_misses(model, bits, monkeypatch)
    reference = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    for texts in (TEXTS, mixed(), mixed()):
        ids, at = model.encode(*chunk(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [reference.encode_ordinary(t) for t in texts]
        text, ends = model.decode(ids)
        assert [text[ends[a] : ends[b]].tobytes().decode() for a, b in zip(at, at[1:], strict=False)] == texts


@pytest.mark.parametrize("bits", [64, 6])
def test_merge_bpe(bits, monkeypatch):
    model = packing.MergeBPE(public_tokenizers.path("byte_bpe_50k.json"))
    cut_misses(model, bits, monkeypatch)
    for texts in (TEXTS, mixed(), mixed()):
        ids, at = model.encode(*chunk(texts))
        want = [x.ids for x in model.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want


def test_quality_rules(hashed):
    for texts in (TEXTS, ["\n".join(mixed()) for _ in range(3)]):
        got = quality_rules.measure(*chunk(texts))
        for k, t in enumerate(texts):
            lines = [x for x in t.split("\n") if any(c not in " \t\v\f\r" for c in x)]
            w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
            grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
            covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
            assert (got["n_dup_lines"][k], got["n_repeat_words"][k]) == (len(lines) - len(set(lines)), len(covered))


def test_ngram_join(spark):
    texts = [t for pair in PAIRS for t in pair]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.join(df).collect()}
    assert got == {k: k for k in range(len(texts))}
