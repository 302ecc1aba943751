"""Cells of short texts and pieces: every place once at any sizes of blocks, slices and batches, and no seed or candidate as a row."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.functions.sequence import MASK
from helixframe.operators import cells, search, seeds


def differ(a, b, nucleotide=True):
    return sum(not MASK.get(x, 0) & MASK.get(y, 0) if nucleotide else x != y for x, y in zip(a, b, strict=True))


def mutual(a, b):
    return a == b or (differ(a, b) == 0 and any(set(t) <= set("ACGT") for t in (a, b)))


def hot(rng, n, low, high, letters):
    """Copies, runs of one letter and of codes beside random texts."""
    out = ["".join(rng.choices(letters, k=rng.randint(low, high))) for _ in range(n)]
    return [*out, out[0], "A" * high, "A" * low, ("AN" * high)[:high], "N" * low]


def struct(**columns):
    return pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns))


@pytest.mark.parametrize(("letters", "nucleotide", "most"), [("ACGTRYNX", True, None), ("ACGTN", True, 0), ("ACGTRYNx", True, 2), ("MKVANä\U0001f9ec", False, 1)])
def test_every_place_once(monkeypatch, letters, nucleotide, most):
    """``most`` None: mutual matches. Far fewer hits, hashes and letters are held at once than there are."""
    for name, value in (("HITS", 5), ("ROWS", 40), ("LETTERS", 90)):
        monkeypatch.setattr(cells, name, value)
    rng = random.Random(4)
    short, long = hot(rng, 12, 3, 14, letters), hot(rng, 8, 20, 60, letters)
    long += [short[0] + short[1] + "TT" + short[2] * 2]
    size = 16
    parts = [(k, t[i : i + size + 14], i // size, len(t)) for k, t in enumerate(long) for i in range(0, len(t), size)]
    block = cells.Block(struct(key=range(len(short)), s=short, most=[most or 0] * len(short)), nucleotide, most is None)
    got = []
    for q, i, rows, j, start, mismatch in block.places(struct(**dict(zip(("row", "piece", "number", "m"), map(list, zip(*parts, strict=True)), strict=True))), size):
        got += zip(np.array(q["key"])[i].tolist(), np.array(rows["row"])[j].tolist(), start.tolist(), mismatch.tolist(), strict=True)
    want = []
    for a, s in enumerate(short):
        for b, t in enumerate(long):
            for k in range(len(t) - len(s) + 1):
                d, hit = differ(s, t[k : k + len(s)], nucleotide), t[k : k + len(s)]
                if mutual(s, hit) if most is None else d <= most:
                    want.append((a, b, k + 1, d))
    assert sorted(got) == sorted(want) and len(want) > 100


@pytest.mark.parametrize("circular", [False, True])
def test_blocks_and_slices(spark, monkeypatch, circular):
    """Many cells give what one gives, with copies of rows and null ids."""
    rng = random.Random(6)
    q, r = (list(enumerate(hot(rng, 10, low, high, "ACGTACGTRN"))) for low, high in ((8, 12), (14, 40)))
    q, r = ([*x, x[0], (None, x[1][1])] for x in (q, r))
    frames = [spark.createDataFrame(x, "id int, sequence string") for x in (q, r)]
    run = lambda: sorted(map(repr, search.map_pairs(*frames, 0.85, circular=circular).union(search.map_pairs(frames[1], frames[0], 0.85)).collect()))
    once = run()
    for name, value in (("BLOCK", 200), ("SLICE", 60), ("LEAST", 1)):
        monkeypatch.setattr(seeds, name, value)
    assert run() == once and len(once) > 100


def test_no_seed_or_candidate_is_a_row(spark, monkeypatch):
    """Runs of one letter that share all seeds and fit nowhere: what is sent is texts and pieces, and no rows are joined."""
    sent = []
    dealt = seeds._dealt
    monkeypatch.setattr(seeds, "_dealt", lambda asked, held, *rest: sent.append(asked.count() + held.count()) or dealt(asked, held, *rest))
    q = spark.range(60).selectExpr("id", "repeat('A', 10) || repeat('C', 10) || 'T' sequence")
    r = spark.range(60).selectExpr("id", "repeat('A', 200) || repeat('C', 9) || 'G' sequence")
    for df in (search.map_pairs(q, r, 1.0), search.mutual_windows(q, r)):
        assert df.count() == 0
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Broadcast" not in plan
    assert len(sent) == 3 and sum(sent) <= 60 * (2 + 1) + 60 * (2 + 1) + 60 * 2
    assert seeds.fitting(q.selectExpr("id s_key", "sequence s", "'+' form", "1 most"), r.selectExpr("id l_key", "sequence l"), F.col("n") <= F.col("m")).count() == 0


def test_a_side_that_is_too_long_is_not_sent(spark, monkeypatch):
    """References that are as long as the queries, or longer, are searched in none of them."""
    sent = []
    dealt = seeds._dealt
    monkeypatch.setattr(seeds, "_dealt", lambda asked, held, *rest: sent.append((asked.count(), held.count())) or dealt(asked, held, *rest))
    q = spark.range(5).selectExpr("id", "'ACGTTGCAAC' || substr('ACGTA', cast(id as int) + 1, 1) sequence")
    r = spark.range(7).selectExpr("id", "'ACGTTGCAACA' || repeat('T', cast(id as int) % 2 * 9) sequence")
    assert search.map_pairs(q, r.where("id % 2 = 0"), 1.0).count() == 2 * 4 and sent[1] == (0, 0)
    assert search.map_pairs(q, r.where("id % 2 = 1"), 1.0).count() == 2 * 3 and sent[3] == (0, 0)
