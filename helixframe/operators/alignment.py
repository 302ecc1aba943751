"""RNA folding in Arrow batches, and alignment by plain scores."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.layout import spread

_PARTNER = {"A": "U", "U": "A", "G": "C", "C": "G"}


def align_pair(a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = -2, local: bool = False) -> tuple[int, str, str, int, int]:
    """(score, aligned a, aligned b, 1-based starts in a and b); ties prefer diagonal, then up, then left."""
    from helixframe.operators.gapped import Scheme, align_one

    r = align_one(a, b, Scheme(match, mismatch, gap, local=local, ties="dul"))
    return r.score, r.first, r.second, r.start1, r.start2


def align(df: DataFrame, a: str = "seq1", b: str = "seq2", local: bool = False, match: int = 2, mismatch: int = -1, gap: int = -2) -> DataFrame:
    """Adds score, aligned1, aligned2, start1, start2; nulls align as empty."""
    from helixframe.operators.gapped import Scheme, align_with

    out = align_with(df, Scheme(match, mismatch, gap, local=local, ties="dul"), a, b)
    return out.select(*df.columns, "score", "aligned1", "aligned2", "start1", "start2")


def fold_rna(s: str) -> tuple[int, str]:
    """Most A-U and G-C pairs, and a balanced dot-bracket structure with that many.

    ``best[i, j]`` counts for the letters i to j; a partner k of i settles all j from k on at once.
    """
    n = len(s)
    if not n:
        return 0, ""
    at = {c: [k for k, x in enumerate(s) if x == c] for c in "ACGU"}
    best = np.zeros((n + 2, n + 1), np.int32)
    for i in range(n - 2, -1, -1):
        row, below = best[i], best[i + 1]
        row[:] = below
        for k in at.get(_PARTNER.get(s[i], ""), []):
            if k > i:
                np.maximum(row[k:], best[k + 1, k:] + (1 + int(below[k - 1])), out=row[k:])
    out, todo = ["."] * n, [(0, n - 1)]
    while todo:
        i, j = todo.pop()
        if i >= j or not best[i, j]:
            continue
        if best[i, j] == best[i + 1, j]:
            todo.append((i + 1, j))
            continue
        k = next(k for k in at[_PARTNER[s[i]]] if i < k <= j and best[i, j] == 1 + best[i + 1, k - 1] + best[k + 1, j])
        out[i], out[k] = "(", ")"
        todo += [(i + 1, k - 1), (k + 1, j)]
    return int(best[0, n - 1]), "".join(out)


#: Letters of texts that are folded together with others as long, and cells of all of their tables.
SHORT_LETTERS, BLOCK_CELLS = 128, 1 << 21
_CODES = np.full(128, 3, np.int8)
_CODES[[ord(c) for c in "AUGC"]] = [1, -1, 2, -2]


def _fold_alike(texts: list[str]) -> list[tuple[int, str]]:
    """``fold_rna`` of equally long texts, a cell of all their tables at a time."""
    n, many = len(texts[0]), len(texts)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(many, n)
    code = _CODES[np.minimum(points, 127)].T.copy()  # partners add up to zero
    best = np.zeros((n + 2, n + 1, many), np.int16)
    for i in range(n - 2, -1, -1):
        row, below = best[i], best[i + 1]
        row[:] = below
        for k in range(i + 1, n):
            pair = np.where(code[i] == -code[k], below[k - 1] + 1, -n - 1).astype(np.int16)
            np.maximum(row[k:], best[k + 1, k:] + pair, out=row[k:])
    mark, column = np.full((n, many), ord("."), np.uint8), np.arange(many)
    end = np.full((n + 2, many), n - 1)  # of the stretch that begins at a letter
    for i in range(n):
        j = end[i]
        value = best[i, j, column]
        opens = (mark[i] == ord(".")) & (i < j) & (value > 0) & (value != best[i + 1, j, column])
        skip = (mark[i] == ord(".")) & ~opens
        end[i + 1, skip] = j[skip]
        left = np.flatnonzero(opens)
        for k in range(i + 1, n):
            if not len(left):
                break
            fits = (code[i, left] == -code[k, left]) & (k <= j[left])
            some = left[fits]
            hit = np.zeros(len(left), bool)
            hit[fits] = value[some] == 1 + best[i + 1, k - 1, some] + best[k + 1, j[some], some]
            some, left = left[hit], left[~hit]
            mark[i, some], mark[k, some] = ord("("), ord(")")
            end[i + 1, some], end[k + 1, some] = k - 1, j[some]
    text = mark.T.tobytes().decode()
    return [(pairs, text[k * n : (k + 1) * n]) for k, pairs in enumerate(best[0, n - 1].tolist())]


def fold_all(texts: Iterable[str]) -> list[tuple[int, str]]:
    """``fold_rna`` of each text; short ones of one length together."""
    texts = list(texts)
    alike: dict[int, list[int]] = {}
    for k, s in enumerate(texts):
        alike.setdefault(len(s), []).append(k)
    out: list = [None] * len(texts)
    for n, rows in alike.items():
        if len(rows) < 4 or not 0 < n <= SHORT_LETTERS:
            for k in rows:
                out[k] = fold_rna(texts[k])
            continue
        size = BLOCK_CELLS // ((n + 2) * (n + 1))
        for lo in range(0, len(rows), size):
            some = rows[lo : lo + size]
            for k, found in zip(some, _fold_alike([texts[k] for k in some]), strict=True):
                out[k] = found
    return out


def fold(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Adds pairs and structure of the transcribed sequence."""

    @F.pandas_udf("pairs bigint, structure string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame(fold_all((x or "").replace("T", "U") for x in s), columns=["pairs", "structure"])

    return spread(df).withColumn("_r", run(F.col(sequence))).select(*df.columns, "_r.*")
