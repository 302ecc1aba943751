"""Every operator against a brute-force version, on small texts with nulls, empties, ties, repeats and clashing extra columns."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from helixframe.llm import byte_bpe, chat_format, exact_dedup, ngram_join, packing, quality_rules, secret_scan, sharding, suffix_dedup, token_store

WS = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, _key long, id string, n int, shard int, tile int, text_sha256 string, ids string"


def words_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(WS, lower)


def corpus(seed=5, n=160):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma", "delta", "é", "x1", "o'k", "The", "of", "and", "l'été", "omega", "sigma;", "tau.", "##"]
    make = lambda k: " ".join(rng.choice(vocab) + rng.choice(["", "", "", "s", str(rng.randint(0, 99))]) for _ in range(k))
    texts = [None, "", " \n\t ", "one", "one two", "ONE two", "a b c", "x" * 5000, "\n\n", "ab " * 700, "日本語 テキスト", "a b", "<|endoftext|> x"]
    base = make(120)
    passage = make(40)
    while len(texts) < n:
        kind = rng.randrange(6)
        if kind == 0:
            texts.append(rng.choice(texts))
        elif kind == 1:
            w = base.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(50))
            texts.append(" ".join(w))
        elif kind == 2:
            texts.append(make(rng.randint(5, 60)) + "\n" + passage + "\n" + make(rng.randint(5, 60)))
        elif kind == 3:
            texts.append((rng.choice(texts) or "").upper())
        else:
            texts.append(make(rng.randint(1, 200)))
    return texts


TEXTS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, k % 3, "x", 1, 2, 3, "s", None) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def jaccard_classes(texts, size, num, den):
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [len(s) for s in sets], [root(k) for k in range(len(texts))]


@pytest.mark.parametrize("few", [0, 2048])
@pytest.mark.parametrize(("size", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 60, 100)])
def test_ngram_join(docs, none, size, num, den, few, monkeypatch):
    spec = ngram_join.Spec(size=size, num=num, den=den, block=4)
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "SLICE", 1024 if few else 3)
    got = rows(ngram_join.join(docs, spec))
    sizes, comps = jaccard_classes(TEXTS, size, num, den)
    assert [got[k]["n_shingles"] for k in range(len(TEXTS))] == sizes
    assert [got[k]["component_id"] for k in range(len(TEXTS))] == comps
    if few and size == 1:
        assert ngram_join.join(none, spec).count() == 0


@pytest.mark.parametrize("few", [0, 2048])
def test_ngram_join_chains(spark, few, monkeypatch):
    """Neighbours link, ends don't: members of a tile meet only through the cross pairs."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "SLICE", 4 if few else 1024)
    w = [f"w{k}" for k in range(40)]
    texts = [" ".join(w[:k] + [f"z{k}"] + w[k + 1 :]) for k in range(30)] + [" ".join(w)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for num in (80, 90):
        got = rows(ngram_join.join(df, ngram_join.Spec(size=1, num=num, den=100, block=3)))
        assert [got[k]["component_id"] for k in range(len(texts))] == jaccard_classes(texts, 1, num, 100)[1]


def test_ngram_join_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (2, "e f g h"), (2, "i j k l"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.join(df).collect()), key=repr)
    assert got == sorted([(None, 3), (None, None), (3, 3), (3, 3), (2, 2), (2, 2)], key=repr)


@pytest.mark.parametrize("fine", [4, 64])
def test_sharding(docs, none, fine):
    got = rows(sharding.shard(docs, shards=8, fine=fine))
    load, slots, where = Counter(), defaultdict(set), defaultdict(set)
    for k, t in enumerate(TEXTS):
        raw = (t or "").encode()
        r = got[k]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        load[r["shard"]] += r["size"]
        slots[r["shard"]].add(r["slot"])
        where[t or ""].add(r["shard"])
    assert set(load) == set(range(8)) and all(s == set(range(len(s))) for s in slots.values())
    assert sum(map(len, slots.values())) == len(TEXTS)
    assert all(len(s) == 1 for s in where.values())
    largest = max(Counter({t: sum(len((x or "").encode()) + 1 for x in TEXTS if (x or "") == t) for t in where}).values())
    assert max(load.values()) - min(load.values()) <= max(largest, sum(load.values()) / 8 / 4)
    assert sharding.shard(none).count() == 0


def test_sharding_hot_group(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("same text " * 5)).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    load = Counter()
    for r in sharding.shard(df).collect():
        load[r.shard] += r.size
    assert max(load.values()) < 1.1 * min(load.values())


@pytest.mark.parametrize(("groups", "copies", "ids"), [(9, 100, "own"), (9, 100, "null"), (3, 400, "one"), (13, 50, "own")])
def test_sharding_equal_groups(spark, groups, copies, ids):
    """Groups of equal texts that fill no whole number of shards are split; null and repeated ids too."""
    key = {"own": F.col("id"), "null": F.lit(None).cast("long"), "one": F.lit(7).cast("long")}[ids]
    df = spark.range(groups * copies).select(key.alias("doc_id"), F.concat(F.lit("text " * 50), (F.col("id") % groups).cast("string")).alias("text"))
    load, slots = Counter(), defaultdict(list)
    for r in sharding.shard(df).collect():
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    row = 5 * 50 + 2
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= sum(load.values()) / 512 + 2 * row
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == groups * copies


def test_exact_dedup(docs, none):
    got = rows(exact_dedup.classes(docs, capacity=8))
    norm = [(t or "").translate({c: c + 32 for c in range(65, 91)}) for t in TEXTS]
    last, size = {t: k for k, t in enumerate(norm)}, Counter(norm)
    for k, t in enumerate(norm):
        assert got[k] == {"doc_id": k, "keep_id": last[t], "group_size": size[t], "kept": last[t] == k, "text_sha256": hashlib.sha256(t.encode()).hexdigest()}
    assert exact_dedup.classes(none).count() == 0


def byte_key(text):
    return F.pmod(F.xxhash64(text), F.lit(256))


@pytest.mark.parametrize("capacity", [2, 1000])
def test_exact_dedup_collisions(spark, capacity):
    """Texts of one 8-bit key share a chain and stay apart; hot keys are dealt to several entries."""
    texts = [f"Text {k % 700}" if k % 3 else "hot" for k in range(3000)] + [None, "", None]
    df = spark.createDataFrame([(k if k % 50 else None, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = Counter(tuple(r) for r in exact_dedup.classes(df, capacity=capacity, key=byte_key, hot_rows=100).collect())
    norm = [(t or "").lower() for t in texts]
    last, size = {}, Counter(norm)
    for k, t in enumerate(norm):
        if k % 50:
            last[t] = k
    want = Counter((k if k % 50 else None, last.get(t), size[t], (k if k % 50 else None) == last.get(t), hashlib.sha256(t.encode()).hexdigest()) for k, t in enumerate(norm))
    assert got == want


def test_directory(spark):
    top = exact_dedup.KEY_BITS
    keys = lambda values: spark.createDataFrame([(v,) for v in values], "_key long")
    even = exact_dedup.directory(keys([k << top - 6 for k in range(64) for _ in range(10)]), 40)
    assert even == [(k << top - 4, 4) for k in range(16)]
    deep = exact_dedup.directory(keys([5] * 100 + [1 << top - 1]), 40)
    assert (5, top) in deep and (1 << top - 1, 1) in deep and len(deep) == top + 1
    assert exact_dedup.directory(keys([]), 40) == [(0, 0)]


def test_the_index_decides(docs, monkeypatch):
    """Without the right directory no row finds its entry."""
    given = exact_dedup.bucket
    calls = []

    def wrong(key, buckets):
        calls.append(1)
        return given(key, buckets) + int(len(calls) > 1)

    monkeypatch.setattr(exact_dedup, "bucket", wrong)
    with pytest.raises(Exception, match="missing from the index"):
        exact_dedup.classes(docs, capacity=8).collect()


def test_quality_rules(docs, none):
    measured = quality_rules.measurements(docs, keep=("n",))
    got = rows(quality_rules.ledger(measured))
    for k, t in enumerate(TEXTS):
        t = t or ""
        w = re.findall(WS, t)
        lines = [x for x in t.split("\n") if re.search(WS, x)]
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + d for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for d in range(3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert tuple(got[k][m] for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert (got[k]["fail_bits"] & 3 > 0) == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
    assert quality_rules.measurements(none).count() == 0
    bits = [r["fail_bits"] for r in got.values()]
    cut = rows(quality_rules.ablations(quality_rules.ledger(measured), "v2"), "rule")
    for k, rule in enumerate(quality_rules.RULES):
        assert cut[rule]["n_rejected_alone"] == sum(b == 1 << k for b in bits)
        assert cut[rule]["n_kept_without"] == sum(not b & ~(1 << k) for b in bits)


CHATS = [
    (1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", "ok </turn> ### user: \\1 \\ "), (2, 1, "user", "####"), (2, 0, "assistant", "a: b"), (None, 0, "user", "q"),
    (3, 0, "user", "q"), (3, 0, "user", "q"), (4, 0, None, "x"), (5, None, "us: er", "y" * 30000), (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"),
]


def test_chat_format(spark):
    df = spark.createDataFrame([(*c, 1) for c in CHATS], "conv_id long, turn long, role string, text string, turns int")
    out = chat_format.format_conversations(df)
    got = rows(chat_format.read_back(out), "conv_id")
    by = defaultdict(list)
    for c, turn, role, text in CHATS:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: got[c]["valid"] for c in by} == {1: True, 2: False, None: False, 3: False, 4: False, 5: False, -7: True}
    assert got[3]["state"] == "error" and got[None]["state"] == "user"
    assert out.where("conv_id = -7").first().formatted == "### user: \\0\\1 Assistant: \\2 ok</turn>\n### assistant: \\0\\1 Assistant: \\2 ok</turn>\n"
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).count() == 0


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_scan(spark, none):
    rng = random.Random(3)
    draw = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [
        *TEXTS, *prose(200), "é password = abc", "Password: 'abcdef", "API_KEY=x.y-z/1==", "token: token: abcdef", "secreT=sécret1", "AKIA" + draw(b62[:26], 16), "AKIAAKIA" + "A" * 8, "éé " + draw("0123456789abcdef", 24), "Ab" + "f" * 30,
        "ſecret: abcdefg", "x " + draw(b62, 40) + " y", "the " + "verylongordinarywordsrunning" + " on", "1" * 40, "passwd:\n", 'api_key"  =  "' + draw(b62, 9), "日本 " + draw(b62, 64),
    ]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = rows(secret_scan.find(df))
    names = ("assign", "access", "hex")
    for k, t in enumerate(texts):
        want = base_spans(t or "")
        said = [f"{names[kind]}:{a}:{b}" for a, kind, b in want]
        assert [got[k][f"n_{n}"] for n in names] == [sum(kind == i for _, kind, _ in want) for i in range(3)], t
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        spans = got[k]["spans"].split(",") if got[k]["spans"] else []
        assert [s for s in spans if not s.startswith("random")] == said
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
    at = texts.index(next(t for t in texts if t and t.startswith("日本 ")))
    assert got[at]["spans"] == "random:3:67"
    assert not any("random" in got[k]["spans"] for k in range(len(TEXTS)))
    clean = rows(secret_scan.redact(df))
    assert clean[at]["text"] == "日本 [SECRET]" and clean[0]["text"] is None and clean[1]["text"] == ""
    assert secret_scan.find(none).count() == 0 and secret_scan.redact(none).count() == 0


ORDINARY = "the quick brown fox jumps over the lazy dog and some what longer ordinary words follow one another while very many people read a few lines of running text with names like Anna or Berlin in it so that pairs of letters are counted on each side of a way home again from town to house 2024 and 17 more".split()


def prose(n, seed=1):
    """Ordinary texts, from which the scan counts what text looks like."""
    rng = random.Random(seed)
    return [" ".join(rng.choices(ORDINARY, k=60)) for _ in range(n)]


def model_of(texts):
    counts = np.zeros(67 * 67, np.int64)
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        counts += secret_scan.pair_counts(raw, np.array([0, len(raw)]))
    return secret_scan.log_shares(counts)


def test_text_model(spark):
    df = spark.createDataFrame([("ab b", ), (None,), ("", ), ("b" * 20 + " ba",)], "text string")
    held = np.exp(secret_scan.text_model(df))
    a, b = 26, 27
    assert np.allclose([held[67 - 1, a], held[66, b], held[a, b], held[b, a]], [1.5 / 36, 2.5 / 36, 1.5 / 34, 1.5 / 34])


def test_planted_keys(spark):
    """Keys of every encoding among ordinary texts: nine of ten are found, and few spans are none."""
    rng = random.Random(31)
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [low[:6] + digits, (low[:6] + digits).upper(), low.upper() + "234567", low + digits, (low + digits).upper(), low + low.upper() + digits, low + low.upper() + digits + "+/", low + low.upper() + digits + "-_"]
    texts, planted = prose(300, 5), {}
    for size in (32, 48, 64, 300):
        for alphabet in alphabets:
            for _ in range(6):
                key = "".join(rng.choice(alphabet) for _ in range(size))
                planted[len(texts)] = (4, 4 + size)
                texts.append(f"the {key} ends")
    texts += ["/".join(rng.choices([w for w in ORDINARY if w.isalpha()], k=9)) for _ in range(200)] + ["".join(rng.choices([w for w in ORDINARY if w.islower()], k=8)) for _ in range(200)]
    got = rows(secret_scan.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    found = {k: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith(("random", "hex"))] for k, r in got.items()}
    hit = sum(any(a < planted[k][1] and planted[k][0] < b for a, b in found[k]) for k in planted)
    false = sum(len(v) for k, v in found.items() if k not in planted)
    assert hit >= 0.9 * len(planted) and false <= 0.02 * hit


def test_random_battery():
    model = model_of(prose(100))
    rng = random.Random(11)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(64)) for _ in range(200)]
    kept = [secret_scan.battery(x.encode(), model) for x in hexes]
    assert all(n == "hex" for n, _, _ in kept)
    assert sum(p >= 0.001 for _, p, _ in kept) >= 190 and all(q < -20 for _, _, q in kept)
    assert secret_scan.battery(b"0123456789abcdef" * 4, model)[1] < 0.001
    assert secret_scan.battery(b"thequickbrownfoxjumpsoverthelazydog", model)[2] == 0
    x = np.random.default_rng(1).integers(0, 62, (2000, 24))
    assert 0.02 < np.mean([secret_scan.uniformity(r, 62) <= 0.05 for r in x]) < 0.08  # simulated tails hold their level at short lengths


def test_random_parts_of_runs(spark):
    """Random values beside a name, behind a path, and of digits or lower-case letters alone."""
    rng = random.Random(21)
    draw = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    b62 = lower + lower.upper() + digits
    cases = [
        ("DB_AUTH=", draw(b62, 40), ""), ("go ?sig=", draw(b62, 44) + "==", "&x"), ("--auth=", draw(b62, 40), " end"), ("src/app/conf/", draw(b62, 20) + "-" + draw(b62, 20) + "_" + draw(b62, 8), ""),
        ("the-own-name-of-", draw(b62, 20) + "+" + draw(b62, 24), ""), ("x ", draw(lower, 64), ""), ("key-", draw(lower, 64), ""), ("x ", draw(digits, 23), ""), ("é ID=", draw(digits, 22), ""),
    ]
    plain = ["the/quick/way/to/the/other/side/of/town=and/back/again/home", "somewhatlongerordinarywordsfollowoneanother", "with-many-hyphens-in-one-long-name", "1" * 22, "x = " + "=" * 40, "a=b=c=d=e=f=g=h=i=j=k=l=m=n"]
    df = spark.createDataFrame(list(enumerate([*("".join(c) for c in cases), *plain, *prose(300)])), "doc_id long, text string")
    got, clean = rows(secret_scan.find(df)), rows(secret_scan.redact(df))
    for k, (before, value, after) in enumerate(cases):
        assert got[k]["spans"] == f"random:{len(before)}:{len(before + value)}", (before, value)
        assert clean[k]["text"] == before + "[SECRET]" + after
    for k, text in enumerate(plain, len(cases)):
        assert got[k]["spans"] == "" and clean[k]["text"] == text


def test_token_store(spark, docs, none, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(token_store, "SHARD_TOKENS", 4000)
    monkeypatch.setattr(token_store, "BLOCK_TOKENS", 500)
    got = rows(token_store.read(spark, token_store.write(docs, path, 49_408)))
    start = 0
    for k, x in enumerate(Tokenizer.from_file(path).encode_batch([t or "" for t in TEXTS], add_special_tokens=False)):
        ids = [*x.ids, 1]
        raw = np.array(ids, "<u4").tobytes()
        assert got[k] == {"doc_id": k, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(raw), "ids": ids}
        start += len(ids)
    assert token_store.read(spark, token_store.write(none, path, 49_408)).count() == 0


def test_token_store_repeated_rows_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_TOKENS", 100)
    texts = [(3, "a b"), (3, "a b"), (None, "c d e"), (None, None), (1, "f"), (3, "g h")] * 20
    target = token_store.write(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), public_tokenizers.path("word_bpe_49k.json"), 49_408)
    got = sorted(token_store.read(spark, target).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((k, len((t or "").split()) + 1) for k, t in texts)
    assert [r.doc_id for r in got] == sorted((k for k, _ in texts), key=lambda k: (k is not None, k))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    again = token_store.read(spark.newSession(), target)
    assert Counter(tuple(r)[:4] for r in again.collect()) == Counter(tuple(r)[:4] for r in got)


def test_blocks():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 1001):
        x = rng.integers(0, 1 << 32, n, dtype=np.uint32) >> rng.integers(0, 32, n, dtype=np.uint32)
        assert (token_store.unpack(token_store.pack(x), n)[0] == x).all()
        sizes, ranks = token_store.unblock(*token_store.block([n, 0, 70_000], x))
        assert sizes.tolist() == [n, 0, 70_000] and (ranks == x).all()
    with pytest.raises(ValueError, match="version"):
        token_store.unblock(b"\0" * 16, b"")


def test_byte_bpe(docs, none):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got, ids = rows(byte_bpe.round_trip(docs, path)), rows(byte_bpe.encode(docs, path))
    back = rows(byte_bpe.decode(byte_bpe.encode(docs, path), path))
    for k, t in enumerate(TEXTS):
        want = model.encode_ordinary(t or "")
        assert ids[k]["ids"] == want and bytes(back[k]["decoded"]) == (t or "").encode()
        assert got[k]["n_tokens"] == len(want) and got[k]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.round_trip(none, path).count() == 0


def test_pre_tokens_and_merges():
    import pyarrow as pa
    import tiktoken
    from tokenizers import Tokenizer

    from helixframe.llm.textops import chunks

    path = public_tokenizers.path("byte_bpe_50k.json")
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    models = byte_bpe.ByteBPE(ranks), packing.MergeBPE(path)
    tik, lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab '\n\tsrevl.é中1  ! ", k=rng.randrange(25))) for _ in range(3000)] + ["a" * 500, " " * 60 + "x", "it's we'll 's'm", "<|endoftext|>a<|endoftext|>"]
    for model, want in zip(models, ([tik.encode_ordinary(t) for t in texts], [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]), strict=True):
        got = []
        for _, _, data, offsets in chunks(pa.array(texts), 999):
            ids, at = model.encode(data, offsets)
            got += [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
        assert got == want


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(docs, path).collect()
    ids = [[*x.ids, 1] for x in Tokenizer.from_file(path).encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for k, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[k])
    assert set(by_doc) == set(range(len(TEXTS)))
    sizes = []
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert max(sizes) <= 2048 and sum(s < 2048 for s in sizes) <= 1
    assert packing.pack(none, path).count() == 0


def test_packing_repeated_rows(spark):
    """Repeated and null rows are packed each, twice alike."""
    texts = [(1, "red house " * 40)] * 30 + [(None, "blue water " * 30)] * 5 + [(None, None)] * 3
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    a, b = (sorted((tuple(r) for r in packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), window=64).collect()), key=repr) for _ in range(2))
    assert a == b
    whole = Counter()
    for k, start, length, _, total, _, _ in a:
        whole[k, total] += length
    assert all(n % total == 0 for (_, total), n in whole.items()) and sum(n // total for (_, total), n in whole.items()) == len(texts)


def topics(n, words, seed=1):
    """Texts of two topics by turns: even ids share no word with odd ones."""
    rng = random.Random(seed)
    vocab = [["red", "blue", "green", "black", "white", "house", "water", "tree", "stone", "bread"], ["seven", "eight", "three", "four", "night", "music", "paper", "glass", "horse", "river"]]
    vocab = [[f" {a} {b}" for a in v for b in v] for v in vocab]
    return ["".join(rng.choice(vocab[k % 2]) for _ in range(words)) for k in range(n)]


def by_sequence(got):
    out = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        out[r.sequence_id].append(r.doc_id)
    return list(out.values())


def test_packing_fills_windows_with_neighbours(spark):
    """Windows of more than 24 documents: all are of the seed's topic while any is free."""
    df = spark.createDataFrame(list(enumerate(topics(240, 5))), "doc_id long, text string")
    windows = by_sequence(packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), window=400).collect())
    assert max(map(len, windows)) > 24
    assert sum(len({k % 2 for k in w}) > 1 for w in windows) <= 1


def test_packing_brings_near_copies_together(spark, monkeypatch):
    """Many shards: texts with a tenth of their words changed mostly lie in the shard of their copy, and meet it in a window as often as in one index of all; every token is packed once."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 40)
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(3, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(60, 200))) for _ in range(500)]
    pairs = []
    for k in range(0, 500, 2):
        near = [rng.choice(vocab) if rng.random() < 0.1 else w for w in texts[k].split()]
        pairs.append((k, len(texts)))
        texts.append(" ".join(near))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    held, pieces, sizes = defaultdict(set), defaultdict(list), Counter()
    monkeypatch.setattr(packing, "SHARD_DOCS", 1 << 20)
    one = defaultdict(set)
    for r in packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect():
        one[r.doc_id].add(r.sequence_id)
    for r in got:
        held[r.doc_id].add(r.sequence_id)
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
        sizes[r.sequence_id] += r.length
    assert len({x >> 36 for v in held.values() for x in v}) > 15 and len({x >> 36 for v in one.values() for x in v}) == 1
    assert sum(bool({x >> 36 for x in held[a]} & {x >> 36 for x in held[b]}) for a, b in pairs) >= 0.9 * len(pairs)
    assert sum(bool(held[a] & held[b]) for a, b in pairs) >= sum(bool(one[a] & one[b]) for a, b in pairs)
    assert max(sizes.values()) <= 2048 and len(pieces) == len(texts)
    for found in pieces.values():
        at = 0
        for start, length, total in sorted(found):
            assert start == at
            at += length
        assert at == total


def test_packing_scores():
    """Scores by matrix product and postings are BM25's."""
    rng = np.random.default_rng(3)
    parts = [rng.zipf(1.3, rng.integers(1, 60)) % 300 for _ in range(200)]
    seen = np.bincount(np.concatenate([np.unique(p) for p in parts]), minlength=300)
    corpus = packing.Corpus.of(200, 30.0, seen)
    column = np.full(300, -1)
    column[np.argsort(np.where(corpus.idf > 0, -seen, 1))[:20]] = np.arange(20)
    score = packing.Index(parts, packing.Corpus(corpus.idf, 30.0, column)).scores(np.arange(200))
    for a in range(0, 200, 7):
        for b in range(200):
            tf = Counter(parts[b].tolist())
            want = sum(max(0.0, corpus.idf[t]) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(parts[b]) / 30.0)) for t in set(parts[a].tolist()) if t in tf)
            assert abs(score[a, b] - want) < 1e-3
    order = list(packing.ranked(score[5], np.arange(200) % 3 > 0))
    assert order == sorted((k for k in range(200) if k % 3 and score[5, k] > 0), key=lambda k: (-score[5, k], k))


def brute_repeats(texts, length):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                mark[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, m in zip(raw, mark, strict=True) if not m)
        spans = sum(m and (i == 0 or not mark[i - 1]) for i, m in enumerate(mark))
        out.append((len(raw), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram"), [(100, 20), (30, 8)])
def test_suffix_dedup(spark, docs, none, length, gram):
    got = rows(suffix_dedup.dedup(docs, length, gram))
    want = brute_repeats(TEXTS, length)
    assert [tuple(got[k][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for k in range(len(TEXTS))] == want
    assert sum(w[1] for w in want) > 1000
    assert suffix_dedup.dedup(none, length, gram).count() == 0


def test_suffix_dedup_repeated_rows_and_null_ids(spark):
    """Of wholly equal rows one stays; rows that share an id with other texts are documents of their own; null ids come first."""
    rng = random.Random(3)
    make = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    a, b, c = make(300), make(300), make(300)
    given = [(None, a), (None, a), (None, b), (1, c), (1, c), (1, c), (2, a[50:] + c[:150]), (2, "short"), (2, "short"), (3, b + b), (3, None)]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df).collect()), key=repr)
    order = [a, a, b] if spark.range(1).select(F.xxhash64(F.lit(a)) < F.xxhash64(F.lit(b))).first()[0] else [b, a, a]
    texts = [*order, c, c, c, *[t for _, t in given[6:]]]
    want = sorted(((k, *x) for k, x in zip([None] * 3 + [1] * 3 + [2, 2, 2, 3, 3], brute_repeats(texts, 100), strict=True)), key=repr)
    assert got == want
    assert sum(x[2] for x in got) == 300 + 600 + 250 + 150 + 600


def test_anchors_do_not_depend_on_the_chunk():
    rng = random.Random(1)
    text = np.frombuffer("".join(rng.choice("ab") for _ in range(400)).encode(), np.uint8)
    alone = suffix_dedup.contexts(text, np.array([0, 400]), 100, 20)
    more = np.frombuffer("".join(rng.choice("ab") for _ in range(300_000)).encode(), np.uint8)
    within = suffix_dedup.contexts(np.concatenate((text, more)), np.array([0, 400, 300_400]), 100, 20)
    for x, y in zip(alone[1:], within[1:], strict=True):
        assert x.tolist() == y[within[0] == 0].tolist()


def test_suffix_dedup_random(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(120):
        if texts and rng.random() < 0.6:
            t = list(rng.choice(texts))
            for _ in range(rng.randrange(4)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice("abé")
            cut = rng.randrange(len(t) + 1)
            texts.append("".join(t[cut:] + t[:cut]))
        else:
            texts.append("".join(rng.choices("abc", [8, 1, 1], k=rng.randrange(200))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = rows(suffix_dedup.dedup(df, 20, 6))
    assert [tuple(got[k][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for k in range(len(texts))] == brute_repeats(texts, 20)


def test_suffix_array():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = rng.integers(0, rng.integers(1, 5), rng.integers(0, 40))
        assert suffix_dedup.suffix_array(a).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())


def test_ngram_join_one_large_group(spark):
    """A group of near copies far larger than a block, with stragglers that link to a few only, and many texts that share most of a template."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(3000):  # chains away from the base
        w = list(base)
        for p in rng.sample(range(60), rng.choice([1, 1, 2, 2, 3])):
            w[p] = f"e{rng.randrange(400)}"
        texts.append(" ".join(w))
    template = [f"t{k}" for k in range(40)]
    texts += [" ".join(template + [f"u{k}x{j}" for j in range(6)]) for k in range(700)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = rows(ngram_join.join(df, ngram_join.Spec(size=1, num=93, den=100, block=64)))
    # brute force over words' bit masks
    number = {}
    masks = [sum(1 << number.setdefault(w, len(number)) for w in set(t.split())) for t in texts]
    sizes = np.array([m.bit_count() for m in masks])
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    grid = np.zeros((len(texts), len(number)), np.float32)
    for k, t in enumerate(texts):
        grid[k, [number[w] for w in set(t.split())]] = 1
    both = grid @ grid.T
    hit = 100 * both >= 93 * (sizes[:, None] + sizes[None, :] - both)
    for a, b in zip(*np.nonzero(np.triu(hit, 1)), strict=True):
        x, y = sorted((root(int(a)), root(int(b))))
        parent[y] = x
    want = [root(k) for k in range(len(texts))]
    assert len(set(want)) > 800
    assert [got[k]["component_id"] for k in range(len(texts))] == want


def test_ngram_join_hot_id(spark):
    """Many different texts under one id, and many copies of one row."""
    given = [(7, f"a{k} b{k} c{k} d{k} e{k}") for k in range(300)] + [(8, "x y z u v w")] * 300 + [(9, "x y z u v w")]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.component_id) for r in ngram_join.join(df).collect())
    assert got == {(7, 7): 300, (8, 8): 300, (9, 8): 1}


@pytest.mark.parametrize("least", [1, 2, ngram_join.SHARED])
def test_few_pairs_are_those_that_sizes_and_tiles_allow(spark, least):
    rng = np.random.default_rng(3)
    sizes, comps = rng.integers(20, 60, 40).tolist(), rng.integers(0, 12, 40).tolist()
    members = {t: rng.choice(40, int(rng.integers(2, 9)), replace=False).tolist() for t in range(60)}
    labelled = spark.createDataFrame([(t, x, sizes[x], comps[x]) for t, xs in members.items() for x in xs], "tile long, set long, size int, comp long")
    spec = ngram_join.Spec()
    found = {tuple(r) for r in ngram_join.few_pairs(ngram_join._opened(labelled), spec, least).collect()}
    met = Counter(p for xs in members.values() for p in itertools.combinations(sorted(xs), 2) if comps[p[0]] != comps[p[1]])
    wanted = {p for p, n in met.items() if n >= least and spec.den * min(sizes[p[0]], sizes[p[1]]) >= spec.num * max(sizes[p[0]], sizes[p[1]])}
    assert found == wanted and wanted
