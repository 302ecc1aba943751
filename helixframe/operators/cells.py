"""A block of short texts against a stream of pieces of long ones, in Arrow batches: what ``seeds`` runs in each of its cells.

Seeds are told by 64-bit hashes (sums of a value a letter and place), one for each
plain text they stand for. A hash only names a candidate: all its letters are
compared, sixteen at a time as four-bit base sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from helixframe.functions.sequence import MASK

#: Plain texts that a hashed seed stands for, at most; four letters never stand for more.
WAYS = 256
#: Lengths of seeds of long pieces, and of a seed's beginnings. Pieces of 8 to 12 letters are seeds whole.
SIZES, LEVELS = (32, 16), (32, 16, 8, 4)
#: The most mismatches for which two pieces are joined.
PAIRED = 8
#: Letters that are looked at together, hashes or candidates made at once, and hits that are held before a stretch is halved.
LETTERS, ROWS, HITS = 1 << 18, 1 << 20, 1 << 20

_UNIT = 1_000_000  # of the logarithms of ways, which are summed as whole numbers
_SETS = np.zeros(128, np.uint8)
_SETS[[ord(c) for c in MASK]] = list(MASK.values())
_COUNT = np.array([m.bit_count() for m in range(16)], np.uint8)
_LOG = np.array([0, 0, _UNIT, 1_584_963, 2 * _UNIT])[_COUNT]
_NIBBLES = np.array([(1 << 4 * k) - 1 for k in range(17)], np.uint64)
_ONES = np.uint64(0x1111111111111111)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A factor a letter of a seed, and the value of the k-th base of each set.
_PLACE = _mixed(np.arange(1 << 40, (1 << 40) + 64)) | np.uint64(1)
_BASES = np.zeros((16, 4), np.uint64)
for _m in range(16):
    _of = [_mixed(np.array([ord(b)]))[0] for k, b in enumerate("ACGT") if _m >> k & 1]
    _BASES[_m, : len(_of)] = _of


def _split(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of items whose sizes sum up to ``most``, or of one item."""
    ends = np.cumsum(sizes)
    out, at, n = [], 0, len(sizes)
    while at < n:
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")), at + 1)
        out.append((at, to))
        at = to
    return out


def _within(counts: np.ndarray) -> np.ndarray:
    """0 to count - 1 for each count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class _Letters:
    """Texts one after the other: code points, base sets, values, sums over what comes before a letter."""

    def __init__(self, letters: np.ndarray, lengths: np.ndarray, nucleotide: bool) -> None:
        self.letters, self.n = letters, lengths
        self.end = np.cumsum(lengths)
        self.begin = self.end - lengths
        self.sets = np.where(letters < 128, _SETS[np.minimum(letters, 127)], 0).astype(np.uint8) if nucleotide else np.zeros(len(letters), np.uint8)
        count = _COUNT[self.sets]
        self.value = np.where(count > 1, np.uint64(0), _mixed(letters))
        before = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        self.log, self.several, self.unplain = before(_LOG[self.sets]), before(count > 1), before(count != 1)
        if nucleotide:
            word = np.concatenate([self.sets, np.zeros(16, np.uint8)]).astype(np.uint64)
            for k in (1, 2, 4, 8):
                word[:-k] |= word[k:] << np.uint64(4 * k)
            self.words = word

    def total(self, sums: np.ndarray, at: np.ndarray, size: int, apart: int, length: int) -> np.ndarray:
        """Of the first ``length`` letters of the seeds at ``at``."""
        first = min(length, size)
        out = sums[at + first] - sums[at]
        return out + sums[at + apart + length - first] - sums[at + apart] if length > first else out

    def hashes(self, at: np.ndarray, size: int, apart: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(number in ``at``, hash) of the plain texts that the first ``length`` letters stand for."""
        places = [k if k < size else apart + k - size for k in range(length)]
        key = np.zeros(len(at), np.uint64)
        for k, o in enumerate(places):
            key += self.value[at + o] * _PLACE[k]
        several = self.total(self.several, at, size, apart, length) > 0
        if not several.any():
            return np.arange(len(at)), key
        row, plain = np.flatnonzero(several), np.flatnonzero(~several)
        grown = key[row]
        for k, o in enumerate(places):
            own = self.sets[at[row] + o]
            ways = np.maximum(np.where(_COUNT[own] > 1, _COUNT[own], 1), 1).astype(np.int64)
            if (ways > 1).any():
                bases = _BASES * _PLACE[k]
                bases[_COUNT < 2] = 0
                grown = np.repeat(grown, ways) + bases[np.repeat(own, ways), _within(ways)]
                row = np.repeat(row, ways)
        return np.concatenate([plain, row]), np.concatenate([key[plain], grown])


def _levels(length: int) -> list[int]:
    """Lengths of beginnings that a seed may be told by, the whole first."""
    return [length, *[s for s in LEVELS if s < length]]


def _depth(text: _Letters, at: np.ndarray, size: int, apart: int, length: int) -> np.ndarray:
    """Letters of the longest beginning that stands for no more than ``WAYS`` texts."""
    out = np.full(len(at), _levels(length)[-1])
    for level in reversed(_levels(length)[:-1]):
        out[text.total(text.log, at, size, apart, level) <= 8 * _UNIT] = level
    return out


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all, letters of each)."""
    held = column.to_pylist()
    return np.frombuffer("".join(held).encode("utf-32-le"), np.uint32), np.fromiter(map(len, held), np.int64, len(held))


class Block:
    """Short texts (s, most and any other columns), their seeds, and the tables of seeds that are made as they are asked for."""

    def __init__(self, rows: pa.StructArray, nucleotide: bool, mutual: bool) -> None:
        self.columns = {f.name: c for f, c in zip(rows.type, rows.flatten(), strict=True)}
        self.nucleotide, self.mutual = nucleotide, mutual
        self.text = _Letters(*_texts(self.columns["s"]), nucleotide)
        self.most = self.columns["most"].to_numpy(zero_copy_only=False).astype(np.int64)
        n, most = self.text.n, self.most
        one, two = n // (most + 1), n // (most + 2)
        paired = (one < 8) & (two >= 2) & (most <= PAIRED)
        size, step = np.where(paired, two, np.minimum(one, 12)), np.where(paired, two, one)
        for s in reversed(SIZES):
            size = np.where(~paired & (one >= s), s, size)
        found: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for s in np.unique(size[~paired]):
            q = np.flatnonzero(~paired & (size == s))
            times = most[q] + 1 if s else np.ones(len(q), np.int64)
            found.setdefault((int(s), 0), []).append((np.repeat(q, times), _within(times) * np.repeat(step[q], times)))
        for s, m in {(int(a), int(b)) for a, b in zip(size[paired], most[paired], strict=True)}:
            q = np.flatnonzero(paired & (size == s) & (most == m))
            for j in range(m + 2):
                for i in range(j):
                    found.setdefault((s, (j - i) * s), []).append((q, np.full(len(q), i * s)))
        #: (letters of a piece's seed, distance of two pieces or 0): short text and offset of each seed, and its depth
        self.seeds = {kind: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for kind, parts in found.items()}
        self.length = {(s, apart): 2 * s if apart else s for s, apart in self.seeds}
        self.depth = {k: _depth(self.text, self.text.begin[q] + o, *k, self.length[k]) for k, (q, o) in self.seeds.items()}
        self.tables: dict[tuple, tuple | None] = {}

    def table(self, kind: tuple[int, int], level: int, on: bool) -> tuple | None:
        """(shift, starts, hashes, seeds) of the seeds that end at a level or (``on``) go on behind it; None without any."""
        name = (*kind, level, on)
        if name not in self.tables:
            which = np.flatnonzero(self.depth[kind] > level if on else self.depth[kind] == level)
            q, offset = (x[which] for x in self.seeds[kind])
            number, key = self.text.hashes(self.text.begin[q] + offset, *kind, level)
            order = np.argsort(key, kind="stable")
            bits = max(1, min(24, len(key).bit_length()))
            key, shift = key[order], np.uint64(64 - bits)
            starts = np.concatenate([[0], np.cumsum(np.bincount((key >> shift).astype(np.int64), minlength=1 << bits))]).astype(np.int32)
            self.tables[name] = (shift, starts, key, which[number[order]].astype(np.int32)) if len(key) else None
        return self.tables[name]

    def _agreed(self, q: np.ndarray, text: _Letters, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, mismatches) of the candidates that are hits."""
        mine, n, differ, same = self.text, self.text.n[q], np.zeros(len(q), np.int64), np.ones(len(q), bool)
        per, alive = 16 if self.nucleotide else 1, np.arange(len(q))
        for at in range(0, int(n.max(initial=0)), per):
            now = alive[n[alive] > at]
            if not len(now):
                break
            i, j = mine.begin[q[now]] + at, start[now] + at
            if self.nucleotide:
                a, b, held = mine.words[i], text.words[j], _NIBBLES[np.minimum(n[now] - at, 16)]
                x = a & b
                x |= x >> np.uint64(2)
                x |= x >> np.uint64(1)
                differ[now] += np.bitwise_count(~x & _ONES & held)
                if self.mutual:
                    same[now] &= (a ^ b) & held == 0
            else:
                differ[now] += mine.letters[i] != text.letters[j]
            alive = alive[same[alive] | (differ[alive] == 0)] if self.mutual else alive[differ[alive] <= self.most[q[alive]]]
        if self.mutual:
            unknown = alive[same[alive] & (differ[alive] > 0)]  # letters without a base set, which are equal only if they are
            for at in range(int(n[unknown].max(initial=0))):
                now = unknown[n[unknown] > at]
                same[now] &= mine.letters[mine.begin[q[now]] + at] == text.letters[start[now] + at]
            i, j, m = mine.begin[q[alive]], start[alive], n[alive]
            plain = (mine.unplain[i + m] == mine.unplain[i]) | (text.unplain[j + m] == text.unplain[j])
            alive = alive[same[alive] | (plain & (differ[alive] == 0))]
        return alive, differ[alive]

    def _met(self, text: _Letters, at: np.ndarray, kind: tuple[int, int], level: int, on: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(short text, its start) of the seeds that the stretches at ``at`` share a beginning with."""
        held = self.table(kind, level, on) if len(at) else None
        if held is None:
            return
        shift, starts, keys, seeds = held
        ways = np.exp2(text.total(text.log, at, *kind, level) / _UNIT)
        for a, b in _split(ways, ROWS):
            number, key = text.hashes(at[a:b], *kind, level)
            slot = (key >> shift).astype(np.int64)
            counts = (starts[slot + 1] - starts[slot]).astype(np.int64)
            some = np.flatnonzero(counts)
            for c, d in _split(counts[some], ROWS):
                few = some[c:d]
                row = np.repeat(few, counts[few])
                k = starts[slot[row]] + _within(counts[few])
                good = keys[k] == key[row]
                q, offset = (x[seeds[k[good]]] for x in self.seeds[kind])
                yield q, at[a:b][number[row[good]]] - offset

    def _stretch(self, text: _Letters, skipped: np.ndarray, whole: np.ndarray, size: int, low: int, high: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(short text, row, start in its piece, mismatches), each once, of the places that start from ``low`` to before ``high`` in their pieces.

        Where more than ``HITS`` turn up, rows or starts are halved and looked at again.
        """
        row_of = np.repeat(np.arange(len(text.n)), text.n)
        inside = np.arange(len(row_of)) - text.begin[row_of]
        found, held = [], 0
        for kind, (_, offsets) in self.seeds.items():
            s, apart = kind
            length = self.length[kind]
            at = np.flatnonzero((inside >= low) & (inside < high + int(offsets.max(initial=0))) & (inside + s + apart <= text.n[row_of]))
            depth = _depth(text, at, s, apart, length)
            for level in _levels(length):  # two seeds meet on the shorter of their beginnings
                for stretches, on in ((at[depth >= level], False), (at[depth == level] if level < length else at[:0], True)):
                    for q, start in self._met(text, stretches, kind, level, on):
                        good = start >= 0
                        q, start = q[good], start[good]
                        row = row_of[start]
                        first = start - text.begin[row]
                        good = (first >= low) & (first < high) & (start + self.text.n[q] <= text.end[row]) & (skipped[row] + first < whole[row])
                        q, start = q[good], start[good]
                        kept, differ = self._agreed(q, text, start)
                        if not len(kept):
                            continue
                        found.append((q[kept] << 32 | start[kept], differ))
                        held += len(kept)
                        if held > HITS and (len(text.n) > 1 or high - low > 1):
                            yield from self._halves(text, skipped, whole, size, low, high)
                            return
        if found:
            hits, first = np.unique(np.concatenate([x for x, _ in found]), return_index=True)
            start = hits & 0xFFFFFFFF
            row = row_of[start]
            yield hits >> 32, row, start - text.begin[row], np.concatenate([x for _, x in found])[first]

    def _halves(self, text: _Letters, skipped: np.ndarray, whole: np.ndarray, size: int, low: int, high: int) -> Iterator[tuple[np.ndarray, ...]]:
        n = len(text.n)
        if n == 1:
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle, high)):
                yield from self._stretch(text, skipped, whole, size, a, b)
            return
        for a, b in ((0, n // 2), (n // 2, n)):
            part = _Letters(text.letters[text.begin[a] : text.end[b - 1]], text.n[a:b], self.nucleotide)
            for q, row, start, differ in self._stretch(part, skipped[a:b], whole[a:b], size, low, high):
                yield q, row + a, start, differ

    def places(self, rows: pa.StructArray, size: int) -> Iterator[tuple[dict[str, pa.Array], np.ndarray, dict[str, pa.Array], np.ndarray, np.ndarray, np.ndarray]]:
        """(columns of the block, rows in them, columns of the pieces, rows in them, starts from 1, mismatches).

        ``rows``: piece, number, m (letters of the text, without those that a circular one repeats) and any other
        columns. A piece goes on behind its first ``size`` letters for as many as a place that starts in them may need.
        """
        columns = {f.name: c for f, c in zip(rows.type, rows.flatten(), strict=True)}
        letters, lengths = _texts(columns["piece"])
        skipped = columns["number"].to_numpy(zero_copy_only=False).astype(np.int64) * size
        whole = columns["m"].to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        for a, b in _split(lengths, LETTERS):
            text = _Letters(letters[ends[a] - lengths[a] : ends[b - 1]], lengths[a:b], self.nucleotide)
            high = min(size, int(lengths[a:b].max(initial=0)))
            for q, row, start, differ in self._stretch(text, skipped[a:b], whole[a:b], size, 0, high):
                for k in range(0, len(q), ROWS // 8):
                    part = slice(k, k + ROWS // 8)
                    yield self.columns, q[part], columns, row[part] + a, skipped[a:b][row[part]] + start[part] + 1, differ[part]
