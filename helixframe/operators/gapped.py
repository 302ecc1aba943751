"""Alignment under a scoring scheme: border gaps, diagonal floors, tie orders, read merging, families.

Rows of the matrix are filled by numpy; every k-th row is kept (k about the root
of their number) and blocks are filled again during the traceback, so a pair needs
memory for about two roots of rows whatever its length. Short pairs of equal
lengths are aligned together, a row of all their matrices at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.layout import spread
from helixframe.operators.alignment import fold_all


@dataclass(frozen=True)
class Scheme:
    """Scores of an alignment.

    floor: least score of a diagonal step; begin_gap, end_gap: gaps before and
    behind a whole sequence (None: like others); local: best stretch only, starting
    at the first best cell or the ``last_cell``; ties: traceback preference of
    d(iagonal), u(p), l(eft), e (diagonal by floor).
    """

    match: int = 2
    mismatch: int = -1
    gap: int = -2
    floor: int | None = None
    begin_gap: int | None = None
    end_gap: int | None = None
    local: bool = False
    last_cell: bool = False
    ties: str = "dule"
    ignore_case: bool = False


GLOBAL = Scheme(floor=-1)
LOCAL = Scheme(floor=-1, local=True)
FREE_ENDS = Scheme(begin_gap=0, end_gap=0, ties="uld", ignore_case=True)
COUNTED = Scheme(local=True, last_cell=True, ties="dlu")
MERGING = Scheme(local=True, last_cell=True, ties="uld")
FAMILY = Scheme(3, -2, -3)


@dataclass(frozen=True)
class Alignment:
    score: int
    first: str
    second: str
    start1: int
    end1: int
    start2: int
    end2: int
    n_match: int
    n_mismatch: int
    n_gap: int


class _Matrix:
    def __init__(self, a: str, b: str, scheme: Scheme):
        code = lambda s: np.frombuffer((s.casefold() if scheme.ignore_case and len(s.casefold()) == len(s) else s).encode("utf-32-le"), np.uint32)
        self.s, self.x, self.y = scheme, code(a), code(b)
        self.n, self.m = len(self.x), len(self.y)
        self.begin = 0 if scheme.local else scheme.gap if scheme.begin_gap is None else scheme.begin_gap
        self.end = scheme.gap if scheme.end_gap is None or scheme.local else scheme.end_gap
        self.at = np.arange(self.m + 1, dtype=np.int64)
        self.step = max(1, int(np.sqrt(self.n)) + 1)
        row, self.kept, self.best = self.begin * self.at, {}, (0, 0, 0)
        self.kept[0] = row
        for i in range(1, self.n + 1):
            row = self._next(row, i)
            if i % self.step == 0:
                self.kept[i] = row
            if scheme.local and self.m:
                top = int(row.max())
                if top > self.best[0] or (scheme.last_cell and top == self.best[0] and top > 0):
                    j = self.m - int(np.argmax(row[::-1])) if scheme.last_cell else int(np.argmax(row))
                    self.best = (top, i, j)
        if not scheme.local:
            self.best = (int(row[-1]), self.n, self.m)
        self.low, self.block = -1, []

    def substitution(self, i: int) -> np.ndarray:
        return np.where(self.y == self.x[i - 1], self.s.match, self.s.mismatch)

    def _next(self, row: np.ndarray, i: int) -> np.ndarray:
        step = self.substitution(i)
        if self.s.floor is not None:
            step = np.maximum(step, self.s.floor)
        up = row + self.s.gap
        up[-1] = row[-1] + self.end
        up[0] = self.begin * i
        out = up
        out[1:] = np.maximum(up[1:], row[:-1] + step)
        if self.s.local:
            out = np.maximum(out, 0)
        along = (self.end if i == self.n else self.s.gap) * self.at
        return np.maximum.accumulate(out - along) + along

    def row(self, i: int) -> np.ndarray:
        low = i // self.step * self.step
        if low != self.low:
            self.low, self.block = low, [self.kept[low]]
        while len(self.block) <= i - low:
            self.block.append(self._next(self.block[-1], low + len(self.block)))
        return self.block[i - low]


def align_one(a: str, b: str, scheme: Scheme = GLOBAL) -> Alignment:
    """Alignment of two strings; empty strings align with gaps only, or not at all in a local scheme."""
    grid = _Matrix(a, b, scheme)
    score, i, j = grid.best
    end1, end2, first, second, counts = i, j, [], [], {"m": 0, "x": 0, "g": 0}
    here = grid.row(i)
    while (i or j) and not (scheme.local and here[j] == 0):
        above = grid.row(i - 1) if i else None
        value, move = here[j], None
        if i and j:
            same = grid.x[i - 1] == grid.y[j - 1]
            scores = {
                "d": above[j - 1] + (scheme.match if same else scheme.mismatch),
                "u": above[j] + (grid.end if j == grid.m else scheme.gap),
                "l": here[j - 1] + (grid.end if i == grid.n else scheme.gap),
                "e": above[j - 1] + scheme.floor if scheme.floor is not None else None,
            }
            move = next(t for t in scheme.ties if scores[t] is not None and scores[t] == value)
        else:
            move = "u" if i else "l"
        if move in "de":
            counts["m" if same else "x"] += 1
        else:
            counts["g"] += 1
        first.append("-" if move == "l" else a[i - 1])
        second.append("-" if move == "u" else b[j - 1])
        i, j = i - (move != "l"), j - (move != "u")
        here = here if move == "l" else above
    return Alignment(score, "".join(first[::-1]), "".join(second[::-1]), i + 1, end1, j + 1, end2, counts["m"], counts["x"], counts["g"])


#: Cells of a matrix that is filled whole and together with others of its shape, and of all of these.
SHORT_CELLS, BLOCK_CELLS = 1 << 14, 1 << 21


def _codes(texts: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), width)


def _strings(codes: np.ndarray, size: np.ndarray) -> list[str]:
    """The last ``size`` letters of each row."""
    width = codes.shape[1]
    text = codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return [text[(k + 1) * width - n : (k + 1) * width] for k, n in enumerate(size.tolist())]


def _align_alike(a: list[str], b: list[str], scheme: Scheme) -> list[Alignment]:
    """``align_one`` of pairs whose first strings, and whose second ones, are equally long: the same recurrence, ties and ends for all of them at once."""
    fold = lambda s: s.casefold() if scheme.ignore_case and len(s.casefold()) == len(s) else s
    n, m, many = len(a[0]), len(b[0]), len(a)
    raw_x, raw_y = _codes(a, n), _codes(b, m)
    x, y = (_codes([fold(s) for s in a], n), _codes([fold(s) for s in b], m)) if scheme.ignore_case else (raw_x, raw_y)
    begin = 0 if scheme.local else scheme.gap if scheme.begin_gap is None else scheme.begin_gap
    end = scheme.gap if scheme.end_gap is None or scheme.local else scheme.end_gap
    step = np.where(x[:, :, None] == y[:, None, :], scheme.match, scheme.mismatch).astype(np.int32)
    floored = step if scheme.floor is None else np.maximum(step, scheme.floor)
    at = np.arange(m + 1, dtype=np.int32)
    h = np.empty((many, n + 1, m + 1), np.int32)
    h[:, 0] = begin * at
    for i in range(1, n + 1):
        row = h[:, i - 1] + scheme.gap
        row[:, -1] = h[:, i - 1, -1] + end
        row[:, 0] = begin * i
        np.maximum(row[:, 1:], h[:, i - 1, :-1] + floored[:, i - 1], out=row[:, 1:])
        if scheme.local:
            np.maximum(row, 0, out=row)
        along = (end if i == n else scheme.gap) * at
        h[:, i] = np.maximum.accumulate(row - along, axis=1) + along
    pair = np.arange(many)
    if scheme.local:
        cells = h[:, 1:].reshape(many, -1)
        best = cells.shape[1] - 1 - cells[:, ::-1].argmax(1) if scheme.last_cell else cells.argmax(1)
        score = cells[pair, best]
        i, j = np.where(score > 0, best // (m + 1) + 1, 0), np.where(score > 0, best % (m + 1), 0)
        score = np.maximum(score, 0)
    else:
        i, j, score = np.full(many, n), np.full(many, m), h[:, n, m]
    end1, end2 = i.copy(), j.copy()
    first, second = np.zeros((many, n + m), np.uint32), np.zeros((many, n + m), np.uint32)
    size, n_match, n_mismatch = (np.zeros(many, np.int64) for _ in range(3))
    for column in range(n + m - 1, -1, -1):
        value = h[pair, i[pair], j[pair]]
        pair, value = (z[((i[pair] > 0) | (j[pair] > 0)) & ~(scheme.local & (value == 0))] for z in (pair, value))
        if not len(pair):
            break
        r, c = i[pair], j[pair]
        inner, up, left = (r > 0) & (c > 0), np.maximum(r - 1, 0), np.maximum(c - 1, 0)
        corner = h[pair, up, left]
        ways = {
            "d": corner + step[pair, up, left],
            "u": h[pair, up, c] + np.where(c == m, end, scheme.gap),
            "l": h[pair, r, left] + np.where(r == n, end, scheme.gap),
        } if n and m else {}
        if scheme.floor is not None and ways:
            ways["e"] = corner + scheme.floor
        move = np.full(len(pair), "", "U1")
        for t in scheme.ties:
            if t in ways:
                move[(move == "") & inner & (ways[t] == value)] = t
        move[~inner] = np.where(r[~inner] > 0, "u", "l")
        down, right = move != "l", move != "u"
        first[pair, column] = np.where(down, raw_x[pair, up], ord("-")) if n else ord("-")
        second[pair, column] = np.where(right, raw_y[pair, left], ord("-")) if m else ord("-")
        both = down & right
        if both.any():
            same = x[pair[both], up[both]] == y[pair[both], left[both]]
            n_match[pair[both]] += same
            n_mismatch[pair[both]] += ~same
        size[pair] += 1
        i[pair], j[pair] = r - down, c - right
    columns = [score, i + 1, end1, j + 1, end2, n_match, n_mismatch, size - n_match - n_mismatch]
    score, start1, end1, start2, end2, n_match, n_mismatch, n_gap = (z.tolist() for z in columns)
    return list(map(Alignment, score, _strings(first, size), _strings(second, size), start1, end1, start2, end2, n_match, n_mismatch, n_gap))


def align_all(a: Iterable[str], b: Iterable[str], scheme: Scheme = GLOBAL) -> list[Alignment]:
    """``align_one`` of each two strings; short ones of equal lengths together."""
    a, b = list(a), list(b)
    alike: dict[tuple[int, int], list[int]] = {}
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        alike.setdefault((len(x), len(y)), []).append(k)
    out: list = [None] * len(a)
    for (n, m), rows in alike.items():
        cells = (n + 1) * (m + 1)
        if len(rows) < 4 or cells > SHORT_CELLS or not n or not m:
            for k in rows:
                out[k] = align_one(a[k], b[k], scheme)
            continue
        size = BLOCK_CELLS // cells
        for lo in range(0, len(rows), size):
            some = rows[lo : lo + size]
            for k, r in zip(some, _align_alike([a[k] for k in some], [b[k] for k in some], scheme), strict=True):
                out[k] = r
    return out


_SCHEMA = "score bigint, aligned1 string, aligned2 string, start1 bigint, end1 bigint, start2 bigint, end2 bigint, n_match bigint, n_mismatch bigint, n_gap bigint"


def align_with(df: DataFrame, scheme: Scheme = GLOBAL, a: str = "seq1", b: str = "seq2") -> DataFrame:
    """Adds score, both aligned strings, 1-based inclusive ranges and counts; nulls align as empty."""

    @F.pandas_udf(_SCHEMA)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in batches:
            rows = align_all([x or "" for x in left], [y or "" for y in right], scheme)
            yield pd.DataFrame([tuple(vars(r).values()) for r in rows], columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    return spread(df).withColumn("_r", run(F.col(a), F.col(b))).select(*df.columns, "_r.*")


def rescored(first: Column, second: Column, scheme: Scheme = GLOBAL) -> Column:
    """Score of two aligned strings: matches, mismatches and gaps of a scheme without free ends or a floor."""
    step = lambda x, y: F.when((x == "-") | (y == "-"), scheme.gap).when(x == y, scheme.match).otherwise(scheme.mismatch)
    letters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    return F.aggregate(F.zip_with(letters(first), letters(second), step), F.lit(0).cast("bigint"), lambda a, x: a + x)


def sound(seq1: Column, seq2: Column, whole: bool = True) -> Column:
    """Whether the rows' aligned strings are equally long and are the two strings (or, without ``whole``, their given ranges) with gaps."""
    plain = lambda c: F.replace(F.col(c), F.lit("-"), F.lit(""))
    part = lambda s, k: s if whole else F.substring(s, F.col(f"start{k}"), F.length(plain(f"aligned{k}")))
    return (F.length("aligned1") == F.length("aligned2")) & (plain("aligned1") == part(seq1, 1)) & (plain("aligned2") == part(seq2, 2))


def merge_two(a: str, b: str, scheme: Scheme = MERGING) -> str | None:
    """The longer head, the common stretch and the longer tail where the locally aligned parts are equal; else none."""
    return merge_all([a], [b], scheme)[0]


def merge_all(a: Iterable[str], b: Iterable[str], scheme: Scheme = MERGING) -> list[str | None]:
    """``merge_two`` of each two strings."""
    pairs = [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    found = align_all([x for x, _ in pairs], [y for _, y in pairs], scheme)
    joined = lambda x, y, r: max(x[: r.start1 - 1], y[: r.start2 - 1], key=len) + r.first + max(x[r.end1 :], y[r.end2 :], key=len)
    return [joined(x, y, r) if r.first and r.first == r.second else None for (x, y), r in zip(pairs, found, strict=True)]


def merge_reads(df: DataFrame, a: str = "seq1", b: str = "seq2", scheme: Scheme = MERGING) -> DataFrame:
    """Adds merged (null where the reads' aligned parts differ)."""

    @F.pandas_udf("string")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(merge_all([x or "" for x in left], [y or "" for y in right], scheme), dtype=object)

    return spread(df).withColumn("merged", run(F.col(a), F.col(b)))


def pair_scores(df: DataFrame, group: str, id_col: str = "id", sequence: str = "sequence", scheme: Scheme = FAMILY) -> DataFrame:
    """(group, id1, id2, score, distance) of all pairs inside each group; aligned in parallel."""
    left = df.select(group, F.col(id_col).alias("id1"), F.col(sequence).alias("seq1"))
    right = df.select(F.col(group).alias("_g"), F.col(id_col).alias("id2"), F.col(sequence).alias("seq2"))
    pairs = left.join(right, (F.col(group) == F.col("_g")) & (F.col("id1") < F.col("id2"))).drop("_g")
    return align_with(pairs, scheme).select(group, "id1", "id2", "score", (-F.col("score")).alias("distance"))


def align_family_texts(texts: list[str], scheme: Scheme = FAMILY, again: Scheme = GLOBAL) -> list[str]:
    """Progressive alignment by a heap of pairs, the best scored on top (ties: least members).

    The top pair is aligned; its second member is settled, and the first one's new
    form makes new pairs with the members not yet settled, scored by ``again``. A
    pair counts only while both forms are those it was scored with. Settled
    members are not gapped anew; all are padded to one length.
    """
    out, form = list(texts), [0] * len(texts)
    pair = lambda i, j, s: (-align_one(out[i], out[j], s).score, i, j, form[i], form[j])
    heap = [pair(i, j, scheme) for j in range(len(out)) for i in range(j)]
    heapq.heapify(heap)
    while heap:
        _, i, j, *scored = heapq.heappop(heap)
        if scored != [form[i], form[j]]:
            continue
        r = align_one(out[i], out[j], scheme)
        out[i], out[j], form[i], form[j] = r.first, r.second, form[i] + 1, -1
        for k in range(len(out)):
            if k != i and form[k] >= 0:
                heapq.heappush(heap, pair(min(i, k), max(i, k), again))
    width = max(map(len, out), default=0)
    return [s.ljust(width, "-") for s in out]


def align_families(df: DataFrame, group: str, id_col: str = "id", sequence: str = "sequence") -> DataFrame:
    """(group, id, aligned): progressive alignment of each family, by id order. A family is one task's work."""
    schema = df.select(group, id_col).withColumn("aligned", F.lit("")).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col, kind="stable")
        return pd.DataFrame({group: pdf[group], id_col: pdf[id_col], "aligned": align_family_texts(list(pdf[sequence].fillna("")))})

    return df.select(group, id_col, sequence).groupBy(group).applyInPandas(run, schema)


def fold_strands(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Two rows a sequence, direction FW and RV (reverse complement): transcript, pairs, structure."""
    from helixframe.functions.coding import transcribe
    from helixframe.functions.sequence import reverse_complement

    s = F.upper(F.coalesce(F.col(sequence), F.lit("")))
    both = F.array(F.struct(F.lit("FW").alias("direction"), transcribe(s).alias("transcript")), F.struct(F.lit("RV").alias("direction"), transcribe(reverse_complement(s, "acgt")).alias("transcript")))
    rows = spread(df).select("*", F.inline(both))

    @F.pandas_udf("pairs bigint, structure string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(fold_all(texts), columns=["pairs", "structure"])

    return rows.withColumn("_r", run("transcript")).select(*rows.columns, "_r.*")


def structure_text() -> Column:
    """Header with direction, transcript and dot-bracket structure of ``fold_strands`` rows as text."""
    return F.concat(F.lit(">"), F.col("id").cast("string"), F.lit("|"), "direction", F.lit("\n"), "transcript", F.lit("\n"), "structure")

