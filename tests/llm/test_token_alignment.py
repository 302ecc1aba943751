"""The group dictionary against token-by-token alignment of whole texts by the libraries themselves."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from helixframe.llm import token_alignment
from helixframe.llm.packing import byte_letters

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def texts():
    rng = random.Random(11)
    found = [None, "", " ", "  ", "a", "a ", " a", "a  b\n c ", "\n", "\n\n x", "\t \ty", "x" * 3000, "▁", "a▁b", "a ▁ b", "<s> </s> <unk>", "<|endoftext|> x", "<0x41>", "a\0b", "é" * 40, "日本語 テキスト　x", "😀 😀👍🏽", "ﬁ ½ ² Å", "don't we'll  I'M", "a b  c", "  x", "naïve café " * 30]
    letters = "ab' \n\t.,1é日▁😀 　"
    found += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    words = ["the", "of", "Alpha", "beta;", "x=1", "https://a.b/c?d", "naïve", "12,345.6", "won't", "--", "日本"]
    found += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(30)]
    return found + found[-5:]


TEXTS = texts()


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = byte_letters()
    docs = []
    for t in texts:
        want = (" " + t).encode() if t else b""
        a = tokenizer.encode(" " + t, add_special_tokens=False).ids if t else []
        b = model.encode(t) if t else []
        a_bytes = [bytes(letters[c] for c in tokenizer.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [model.id_to_piece(i)]]
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            a, b, a_bytes, b_bytes = [], [], [], []
        spans = lambda parts: [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k in range(len(parts))]
        sa, sb = spans(a_bytes), spans(b_bytes)
        links = [(x, y) for x, (s, e) in zip(a, sa, strict=True) for y, (u, v) in zip(b, sb, strict=True) if s < v and u < e]
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [([x for x, (_, e) in zip(a, sa, strict=True) if low < e <= end], [y for y, (_, e) in zip(b, sb, strict=True) if low < e <= end]) for low, end in zip([0, *ends], ends, strict=False)]
        docs.append((a, b, links, groups))
    count = Counter(x for d in docs for x in d[2])
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for a, b, links, groups in docs:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, [d[3] for d in docs], count


@pytest.fixture(scope="module")
def expected():
    return brute([t[:400] if t and len(t) > 2000 else t for t in TEXTS])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t[:400] if t and len(t) > 2000 else t, "x", 7, 3) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, block int, n_best int").repartition(4)


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block_bytes", [1, 500, 8 << 20])
def test_align(docs, expected, block_bytes):
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in token_alignment.align(docs, A, B, block_bytes=block_bytes).collect()}
    assert found == dict(enumerate(expected[0]))
    assert sum(x[0] == 0 for x in found.values()) > 5  # empty ones and those that the pieces don't spell


def test_groups_are_returned(docs, expected):
    found = {r.doc_id: [(list(g.a), list(g.b)) for g in r.groups] for r in token_alignment.token_groups(docs, A, B).collect()}
    assert found == dict(enumerate(expected[1]))


def test_tables_emptied_between_blocks(docs, expected, monkeypatch):
    monkeypatch.setattr(token_alignment, "KEEP", 3)
    token_alignment._made.clear()
    df = docs.coalesce(1)
    held = token_alignment.blocks(df, A, B, "doc_id", "text", 100)
    links = token_alignment.expand(held.select(F.explode(F.arrays_zip("keys", "freq")).alias("e")).select("e.keys", "e.freq").groupBy("keys").agg(F.sum("freq").alias("freq")), A, B)
    found = {(r.a, r.b): r.n for r in token_alignment.pair_counts(links).collect()}
    assert found == dict(expected[2])


def test_odd_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "a b"), (None, None), (2, None)]
    found = token_alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
    assert sorted((r.doc_id or 0, r.n_a, r.count_sum) for r in found) == sorted([(1, 2, 6), (1, 2, 6), (1, 1, 1), (0, 2, 6), (0, 0, 0), (2, 0, 0)])
    assert token_alignment.align(spark.createDataFrame([], "doc_id int, text string"), A, B).count() == 0


def test_one_long_text_without_spaces(spark):
    text = "abcdé" * 40_000
    (row,) = token_alignment.align(spark.createDataFrame([("k", text)], "doc_id string, text string"), A, B).collect()
    assert row.doc_id == "k" and row.n_links == row.n_a + row.n_b - row.n_groups and row.n_a > 40_000
