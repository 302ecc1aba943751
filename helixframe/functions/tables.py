"""Table functions that SQL text calls with a TABLE argument, partitioned and ordered by the caller."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, arrow_udtf, udtf
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


class MergedSpans:
    """``merged_spans(TABLE(t) PARTITION BY key ORDER BY (start, end), gap)``: spans of a partition that overlap or lie within ``gap`` positions of each other, merged.

    The table has columns ``start`` and ``end`` (inclusive); the other columns of a result row are those of the first
    span merged into it. Rows come in the caller's order, one at a time, so a partition of any size needs the memory of one span.
    Rows out of order, or with a null bound, raise.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, gap: AnalyzeArgument | None = None) -> AnalyzeResult:
        names = [f.name for f in table.dataType.fields]
        if not table.isTable or not {"start", "end"} <= set(names):
            raise ValueError("merged_spans needs a TABLE argument with columns start and end")
        kept = [f for f in table.dataType.fields if f.name not in ("start", "end")]
        return AnalyzeResult(StructType([*kept, StructField("start", LongType()), StructField("end", LongType()), StructField("n", IntegerType())]))

    def __init__(self) -> None:
        self.held: list | None = None
        self.first: list = []

    def eval(self, row: Row, gap: int = 0) -> Iterator[tuple]:
        low, high = row["start"], row["end"]
        if low is None or high is None or (self.held and low < self.last):
            raise ValueError("spans come in the order of their starts, without nulls")
        self.last = low
        if self.held and low <= self.held[1] + gap + 1:
            self.held[1], self.held[2] = max(self.held[1], high), self.held[2] + 1
            return
        if self.held:
            yield (*self.first, *self.held)
        self.first, self.held = [row[c] for c in row.__fields__ if c not in ("start", "end")], [low, high, 1]

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            yield (*self.first, *self.held)


class MergedSpanBatches:
    """``MergedSpans`` an Arrow batch at a time, for columns named beforehand: Spark analyses no Arrow table functions."""

    def __init__(self) -> None:
        self.held: list | None = None  # start, end and number of what is merged so far
        self.first: pa.RecordBatch | None = None

    def eval(self, table: pa.RecordBatch, gap: pa.Array | None = None) -> Iterator[pa.Table]:
        if not table.num_rows:
            return
        gap = gap[0].as_py() if gap is not None else 0
        low, high = table.column("start"), table.column("end")
        bad = low.null_count or high.null_count
        if not bad:
            low, high = (c.cast(pa.int64()).to_numpy() for c in (low, high))
            bad = (low[1:] < low[:-1]).any() or (self.held and low[0] < self.last)
        if bad:
            raise ValueError("spans come in the order of their starts, without nulls")
        self.last = int(low[-1])
        begins = self._begins(low, high, gap)
        at = begins[0] if len(begins) else len(low)
        if at:
            self.held = [self.held[0], max(self.held[1], int(high[:at].max())), self.held[2] + int(at)]
        if not len(begins):
            return
        out = [self._row()] if self.held else []
        kept = table.select([c for c in table.schema.names if c not in ("start", "end")])
        ends, counts = np.maximum.reduceat(high, begins), np.diff(np.append(begins, len(low)))
        if len(begins) > 1:
            out.append(self._rows(kept.take(pa.array(begins[:-1])), low[begins[:-1]], ends[:-1], counts[:-1]))
        self.held, self.first = [int(low[begins[-1]]), int(ends[-1]), int(counts[-1])], kept.take(pa.array(begins[-1:]))
        if out:
            yield pa.concat_tables(out)

    def _begins(self, low: np.ndarray, high: np.ndarray, gap: int) -> np.ndarray:
        """Where a span begins that isn't merged into those before."""
        if gap >= -1 and (high >= low).all() and int(high.max()) + gap < (1 << 63) - 1:
            reach = self.held[1] if self.held else int(low[0])
            fresh = low > np.maximum.accumulate(np.concatenate(([reach], high[:-1]))) + (gap + 1)
            fresh[0] |= not self.held
            return np.flatnonzero(fresh)
        found, reach = [], self.held and self.held[1]  # spans that end before they start, or must overlap by more
        for k, (x, y) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
            if reach is None or x > reach + gap + 1:
                found.append(k)
                reach = y
            else:
                reach = max(reach, y)
        return np.array(found, np.int64)

    def _rows(self, kept: pa.RecordBatch, *numbers: np.ndarray) -> pa.Table:
        columns = [pa.array(x, t) for x, t in zip(numbers, (pa.int64(), pa.int64(), pa.int32()), strict=True)]
        return pa.Table.from_arrays([*kept.columns, *columns], [*kept.schema.names, "start", "end", "n"])

    def _row(self) -> pa.Table:
        return self._rows(self.first, *([x] for x in self.held))

    def terminate(self) -> Iterator[pa.Table]:
        if self.held:
            yield self._row()


def register(spark: SparkSession, kept: str | None = None) -> None:
    """Make the table functions known to the session's SQL.

    ``kept`` is the DDL of the table's columns besides start and end, in their order, where they are known: SQL analysed
    until the next call merges Arrow batches, a small part of the time of rows.
    """
    spark.udtf.register("merged_spans", udtf(MergedSpans) if kept is None else arrow_udtf(MergedSpanBatches, returnType=f"{kept}, start bigint, `end` bigint, n int"))
