"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements
and one failure bit per rule. A policy is a named, versioned mask of rules: a
document passes when its bits and the mask have nothing in common, so a policy
change or an ablation is a bitwise operation on the ledger, never a new scan.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words and fail
``few_words``. Repeated rows are measured separately, extra columns are left
out of the ledger, an empty table gives an empty ledger, and texts of any
length are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.textops import Hasher, chunks, edges, mix, same_slices, windows, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_alpha_words")
#: Name of each rule, in bit order, and its failure condition over the measurements.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "n_lines >= 4 AND 10 * n_dup_lines > 6 * n_lines",
    "no_letters": "2 * n_alpha_words < n_words",
}
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules each applies.
POLICIES = {"v1-base": BASE, "v2": tuple(RULES)}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True


def mask(policy: str) -> int:
    return sum(1 << k for k, rule in enumerate(RULES) if rule in POLICIES[policy])


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[at])


def _later(keys: list) -> np.ndarray:
    """Positions of keys that are in the list before."""
    seen: set = set()
    return np.array([k for k, x in enumerate(keys) if x in seen or seen.add(x)], np.int64)


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Measurements of each document of a chunk."""
    start, end, at = words(data, offsets)
    n_words = np.diff(at)
    hasher = Hasher(data)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    out = {"n_words": n_words}
    letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    out["word_chars"] = _sums(letters[end] - letters[start], at)
    out["n_symbols"] = _sums(_SYMBOL[data], offsets)
    alpha = np.concatenate(([0], np.cumsum(_LETTERS[data])))
    out["n_alpha_words"] = _sums(alpha[end] > alpha[start], at)
    # lines with a word
    a, b = edges(data, offsets, data == 0x0A)
    word_before = np.searchsorted(start, a), np.searchsorted(start, b)
    full = word_before[1] > word_before[0]
    a, b = a[full], b[full]
    line_doc = np.searchsorted(offsets, a, "right") - 1
    line = mix(hasher.of(a, b) + line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out["n_lines"] = np.bincount(line_doc, minlength=len(n_words))
    _, first, back = np.unique(line, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[back] != np.arange(len(line)))
    lead = first[back][again]
    if ((line_doc[again] != line_doc[lead]) | (b[again] - a[again] != b[lead] - a[lead])).any() or not same_slices(hasher.at, a[again], hasher.at, a[lead], b[again] - a[again]).all():
        again = _later([(d, data[x:y].tobytes()) for d, x, y in zip(line_doc.tolist(), a.tolist(), b.tolist(), strict=True)])  # lines that share a hash
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=len(n_words))
    # words in three-word windows that occur twice or more
    covered = np.zeros(len(start), bool)
    if len(start) >= 3:
        same = doc[2:] == doc[:-2]
        h = mix(windows(hasher.of(start, end), 3) + doc[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        where = np.flatnonzero(same)
        h = h[where]
        order = np.argsort(h)
        sorted_h = h[order]
        equal = np.zeros(len(h), bool)
        if len(h) > 1:
            pair = sorted_h[1:] == sorted_h[:-1]
            x, y = where[order[1:][pair]], where[order[:-1][pair]]
            alike = [same_slices(hasher.at, start[x + k], hasher.at, start[y + k], (end - start)[x + k]) & ((end - start)[x + k] == (end - start)[y + k]) for k in range(3)]
            if not np.logical_and.reduce([doc[x] == doc[y], *alike]).all():  # windows that share a hash
                texts = [(doc[i], *(data[start[i + k] : end[i + k]].tobytes() for k in range(3))) for i in where.tolist()]
                often = Counter(texts)
                hit = where[[often[t] > 1 for t in texts]]
            else:
                equal[1:] |= pair
                equal[:-1] |= pair
                hit = where[order[equal]]
        else:
            hit = where[:0]
        for k in range(3):
            covered[hit + k] = True
    out["n_repeat_words"] = _sums(covered, at)
    return out


def measurements(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Id, the columns in ``keep`` and all measurements of every row."""

    passed = [id_col, *keep]
    sent = [text_col, *(c for c in passed if c != text_col)]  # each column once
    at = [sent.index(c) for c in passed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(0)):
                found = measure(data, offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in at), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], [*passed, *MEASURES])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in passed] + [f"{m} long" for m in MEASURES])
    return df.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(run, schema)


def ledger(measured: DataFrame) -> DataFrame:
    """Adds ``fail_bits``: bit k is set when rule k of ``RULES`` fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    return measured.withColumn("fail_bits", sum(bits[1:], bits[0]).cast("long"))


def passes(policy: str) -> F.Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(ledger_df: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents that only it rejects, and documents kept without it."""
    counts = ledger_df.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << k).alias("bit")) for k, r in enumerate(RULES) if r in POLICIES[policy]])).alias("r")
    alone = F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)
    kept = F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit").cast("long"))) == 0, F.col("n")).otherwise(0)
    return counts.select("bits", "n", rules).groupBy(F.col("r.rule").alias("rule")).agg(F.sum(alone).alias("n_rejected_alone"), F.sum(kept).alias("n_kept_without"))
