"""Secret scan: three fixed patterns, and a randomness test battery with length-aware false-discovery control.

Patterns (code points, leftmost non-overlapping per kind): ``assign`` is a
named credential with a value of 6 or more characters, ``access`` an access key
id of 20 or more, ``hex`` a lower-case hexadecimal run of 24 or more.

Battery: every maximal run of 20 or more characters of ``[A-Za-z0-9+/_-]``, with
the ``=`` that end it, is a test (an ``=`` inside divides). Where it shows no
randomness as a whole, its parts between ``+/``, between ``-_`` and between all
four are tested, p-values times the number of these tests. The encoding is
inferred from the characters used. A run must be consistent with uniform draws
from that alphabet: a chi-squared test, a runs test about the median and a
lag-one serial correlation, of which the least p-value counts; how small it gets
among uniform draws of the same length is simulated (for runs of over 256
characters Bonferroni over the three is used). Its p-value against ordinary text is the
likelihood ratio of text to uniform draws (valid by Markov's inequality, and
smaller for longer runs). Text is what the whole corpus holds: the shares of
characters behind each other in all runs too short to be tested, in a table of
bounded size, so no language is assumed. Runs are discoveries by the Benjamini-Hochberg rule
within each length class over the whole corpus, on p-values binned to a quarter
of a decade; the histogram is of bounded size.

Null and empty texts have no spans. Repeated rows are scanned separately, extra
columns are ignored, an empty table gives an empty result, long texts are read
whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.store import small_batches, stash
from helixframe.llm.textops import chunks, edges

KINDS = ("assign", "access", "hex", "random")
RATE = 0.01
MIN_RUN = 20
CLASSES = (20, 32, 48, 96)
_BINS = 400
_ALPHA = 0.001
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_WORDS = (b"passw", b"secret", b"token", b"key")

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True

_LOWER, _UPPER, _DIGIT = (set(b"abcdefghijklmnopqrstuvwxyz"), set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set(b"0123456789"))
_ALPHABETS = [
    ("digits", b"0123456789"),
    ("hex", b"0123456789abcdef"),
    ("HEX", b"0123456789ABCDEF"),
    ("base32", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", b"abcdefghijklmnopqrstuvwxyz"),
    ("base36", b"abcdefghijklmnopqrstuvwxyz0123456789"),
    ("BASE36", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base62", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
_INDEX = [(name, len(a), set(a), np.array([a.find(bytes([c])) for c in range(256)], np.int64)) for name, a in _ALPHABETS]
_SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_N = len(_SYMBOLS)
_CODE = np.full(256, _N, np.int64)  # any other character: a border
_CODE[list(_SYMBOLS)] = np.arange(_N)
_DRAWS = 4095  #: simulated runs of a length
_EXACT = 256  #: longest run whose tail is simulated
_INNER = re.compile(rb"[^=]+(?:=+\Z)?")
_DIVIDED = [re.compile(x) for x in (rb"[^+/]+", rb"[^_-]+", rb"[^+/_-]+")]


def pair_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each symbol follows each other one or a border, in the runs of a chunk that are too short to be tested."""
    code = np.append(_CODE[data], _N)
    start, end = edges(data, offsets, code[:-1] == _N)
    tested = end - start >= MIN_RUN
    inside = np.zeros(len(code), np.int64)
    inside[start[tested]] += 1
    inside[end[tested]] -= 1
    code[np.cumsum(inside) > 0] = _N
    pair = np.append(_N, code[:-1]) * (_N + 1) + code
    first = offsets[:-1]
    pair[first] = _N * (_N + 1) + code[first]
    return np.bincount(pair[:-1], minlength=(_N + 1) ** 2)


def text_model(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log of the share of each symbol behind each other one, or (last row) at the start of a run, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((_N + 1) ** 2, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                total += pair_counts(data, offsets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["pair", "n"])

    counts = np.zeros((_N + 1) ** 2)
    for row in df.select(text_col).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # pairs of 67 symbols
        counts[row["pair"]] = row["n"]
    return log_shares(counts)


def log_shares(counts: np.ndarray) -> np.ndarray:
    inside = counts.reshape(_N + 1, _N + 1)[:, :_N] + 0.5
    return np.log(inside / inside.sum(1, keepdims=True))


def _p_values(x: np.ndarray, size: int) -> np.ndarray:
    """Least of three approximate p-values of each row of codes below ``size`` being uniform draws."""
    m, n = x.shape
    expected = n / size
    seen = np.bincount((x + np.arange(m)[:, None] * size).ravel(), minlength=m * size).reshape(m, size)
    chi = ((seen - expected) ** 2).sum(1) / expected
    p_chi = _tail((chi - (size - 1)) / np.sqrt(np.maximum(1e-9, 2 * (size - 1) * (n - 1) / n)))
    high = x >= size / 2
    n1 = high.sum(1)
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    mean = 1 + 2.0 * n1 * (n - n1) / n
    var = (mean - 1) * (mean - 2) / max(n - 1, 1)
    p_runs = np.where((n1 > 0) & (n1 < n), 2 * _tail(np.abs(runs - mean) / np.sqrt(np.maximum(var, 1e-9))), 0.0)
    d = x - x.mean(1, keepdims=True)
    spread = (d * d).sum(1)
    serial = np.abs((d[:, 1:] * d[:, :-1]).sum(1)) / np.where(spread > 0, spread, 1.0) * math.sqrt(n)
    p_serial = np.where(spread > 0, 2 * _tail(serial), 0.0)
    return np.minimum(np.minimum(p_chi, p_runs), p_serial)


def _tail(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z.tolist()])


_simulated: dict[tuple[int, int], np.ndarray] = {}


def uniformity(x: np.ndarray, size: int) -> float:
    """P-value of codes below ``size`` being uniform draws: how often the least p-value of such draws is as small."""
    n = len(x)
    least = float(_p_values(x[None, :], size)[0])
    if n > _EXACT:
        return min(1.0, 3 * least)
    if (size, n) not in _simulated:
        draws = np.random.default_rng(size * 1000 + n).integers(0, size, (_DRAWS, n))
        _simulated[size, n] = np.sort(_p_values(draws, size))
    return (1 + int(np.searchsorted(_simulated[size, n], least, "right"))) / (_DRAWS + 1)


def battery(run: bytes, model: np.ndarray) -> tuple[str, float, float]:
    """(encoding, p of being uniform draws, log of the p-value against ordinary text) of a run."""
    body = run.rstrip(b"=")
    used = set(body)
    for name, size, letters, index in _INDEX:
        if used <= letters:
            break
    else:
        return "other", 0.0, 0.0
    codes = np.frombuffer(body, np.uint8)
    n = len(codes)
    if n < MIN_RUN - 2 or (name in ("base62", "base64", "base64url") and not used & _DIGIT and not (used & _UPPER and used & _LOWER)):
        return name, 0.0, 0.0
    symbols = _CODE[codes]
    log_p = min(0.0, float(model[_N, symbols[0]] + model[symbols[:-1], symbols[1:]].sum()) + n * math.log(size))
    if not int(-log_p / math.log(10) * 4):
        return name, 1.0, log_p  # no discovery in any case
    return name, uniformity(index[codes], size), log_p


def _level(run: bytes, model: np.ndarray, tests: int = 1) -> int:
    """Bin of the p-value, times ``tests``, of a run; bin 0 where it isn't consistent with uniform draws."""
    _, uniform, log_p = battery(run, model)
    return max(0, min(_BINS, int(-(log_p + math.log(tests)) / math.log(10) * 4))) if uniform >= _ALPHA else 0


def _tests(run: bytes, model: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, bin of the p-value) of the tests of a run of ``[A-Za-z0-9+/_=-]``."""
    out = []
    for m in _INNER.finditer(run):
        lo, hi = m.span()
        if hi - lo < MIN_RUN:
            continue
        level, found = _level(m[0], model), []
        if not level:
            parts = sorted({x.span() for divided in _DIVIDED for x in divided.finditer(m[0]) if x.end() - x.start() >= MIN_RUN} - {(0, hi - lo)})
            for level_of, a, b in sorted(((-_level(m[0][a:b], model, len(parts)), a, b) for a, b in parts)):
                if level_of and all(b <= x or y <= a for x, y, _ in found):
                    found.append((a, b, -level_of))
        out += [(lo + a, lo + b, sum(b - a >= c for c in CLASSES) - 1, n) for a, b, n in sorted(found) or [(0, hi - lo, level)]]
    return out


def scan_chunk(data: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> Iterator[tuple[list, list]]:
    """For each document of a chunk: base spans (start, kind index, end) and candidates (start, end, class, bin)."""
    raw = data.tobytes()
    cuts = offsets.tolist()
    wide = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))

    def runs(table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = edges(data, offsets, ~table[data])
        long = b - a >= least
        a, b = a[long], b[long]
        return a, b, np.searchsorted(a, offsets)

    hex_a, hex_b, hex_at = runs(_HEX, 24)
    run_a, run_b, run_at = runs(_RUN, MIN_RUN)
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        found = [(int(hex_a[i]), 2, int(hex_b[i])) for i in range(hex_at[k], hex_at[k + 1])]
        text = raw[lo:hi]
        low = text.lower()
        if any(w in low for w in _WORDS):
            found += [(lo + m.start(), 0, lo + m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        if b"AKIA" in text:
            found += [(lo + m.start(), 1, lo + m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
        tested = []
        for i in range(run_at[k], run_at[k + 1]):
            a, b = int(run_a[i]), int(run_b[i])
            first = int(wide[a] - wide[lo])  # a run is of single bytes
            tested += [(first + x, first + y, kind, level) for x, y, kind, level in _tests(raw[a:b], model)]
        yield sorted((int(wide[a] - wide[lo]), kind, int(wide[b] - wide[lo])) for a, kind, b in found), tested


_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
_CAND = "array<struct<start:bigint,end:bigint,class:int,level:int>>"


def scan(df: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, base spans with their counts and digest, and every tested run, per document."""
    small_batches(df.sparkSession)
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    cand = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("class", pa.int32()), ("level", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                rows = list(scan_chunk(data, offsets, model))
                counts = [[sum(k == kind for _, k, _ in base) for base, _ in rows] for kind in range(3)]
                digest = [hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest() for base, _ in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest),
                        pa.array([[dict(zip(("start", "kind", "end"), s, strict=True)) for s in base] for base, _ in rows], span),
                        pa.array([[dict(zip(("start", "end", "class", "level"), c, strict=True)) for c in tested] for _, tested in rows], cand),
                    ],
                    [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "base", "tested"],
                )

    key = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key}, n_assign long, n_access long, n_hex long, base_sha256 string, base {_SPAN}, tested {_CAND}")


def thresholds(scanned: DataFrame, rate: float = RATE) -> list[int]:
    """Least bin that counts as a discovery, per length class (Benjamini-Hochberg over the whole corpus)."""
    hist = scanned.select(F.explode("tested").alias("t")).groupBy("t.class", "t.level").agg(F.count("*").alias("n")).collect()  # classes x bins at most
    out = []
    for c in range(len(CLASSES)):
        counts = np.zeros(_BINS + 1, np.int64)
        for row in hist:
            if row["class"] == c:
                counts[row["level"]] += row["n"]
        above = np.cumsum(counts[::-1])[::-1]
        good = [k for k in range(1, _BINS + 1) if above[k] and counts.sum() * 10 ** (-k / 4) <= rate * above[k]]
        out.append(min(good, default=_BINS + 1))
    return out


def spans(scanned: DataFrame, least: list[int]) -> DataFrame:
    """Adds ``spans``: all spans as kind:start:end in order; random runs that touch a base span are left out."""
    level = F.array(*[F.lit(x) for x in least])
    free = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    drawn = F.filter("tested", lambda t: (t["level"] >= F.get(level, t["class"])) & free(t))
    extra = F.transform(drawn, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = F.array_sort(F.concat("base", extra))
    text = F.array_join(F.transform(joined, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scanned.withColumn("n_random", F.size(extra).cast("long")).withColumn("spans", text).drop("base", "tested")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per document; see the module's head."""
    scanned = stash(scan(df, text_model(df, text_col), id_col, text_col), "secret-scan")
    return spans(scanned, thresholds(scanned, rate))


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """``df`` with every span replaced by ``mark``; other columns pass through. The text model and the thresholds come from passes over all rows."""
    model = text_model(df, text_col)
    least = thresholds(scan(df.select(F.lit(0).alias("_row"), text_col), model, "_row", text_col).select("tested"), rate)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(at)):
                raw, out = data.tobytes(), []
                for k, (base, tested) in enumerate(scan_chunk(data, offsets, model)):
                    given = batch.column(at)[lo + k]
                    cut = sorted([(a, b) for a, _, b in base] + [(a, b) for a, b, c, level in tested if level >= least[c]])
                    if not given.is_valid or not cut:
                        out.append(given.as_py())
                        continue
                    text, done, parts = raw[offsets[k] : offsets[k + 1]].decode("utf-8"), 0, []
                    for a, b in cut:
                        if a >= done:
                            parts += [text[done:a], mark]
                        done = max(done, b)
                    out.append("".join([*parts, text[done:]]))
                columns = [c.slice(lo, hi - lo) for c in batch.columns]
                columns[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, df.schema)
