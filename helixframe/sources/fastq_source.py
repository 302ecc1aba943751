"""FASTQ as a Spark data source whose tasks read byte ranges of a file.

A record starts at a line with ``@`` whose second next line starts with ``+``: a
quality line may start with ``@`` too, but a base line never starts with ``+``.
So any range finds its first record alone, and large files are read in parallel.
Gzip files are one range each. Register with ``spark.dataSource.register(FastqSource)``.
"""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, IsNotNull
from pyspark.sql.types import StructType

SCHEMA = "id string, sequence string, quality string, file string, start bigint, valid boolean, _corrupt_record string"
_FIELDS = pa.schema([("id", pa.string()), ("sequence", pa.string()), ("quality", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("valid", pa.bool_()), ("_corrupt_record", pa.string())])
_BATCH = 4096


def open_uri(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path or URI, size) of a file, or of the files of a folder."""
    fs, inner = open_uri(path)
    info = fs.get_file_info(inner)
    if info.is_file:
        return [(path, info.size)]
    scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    found = sorted(fs.get_file_info(pafs.FileSelector(inner, recursive=True)), key=lambda f: f.path)
    return [(scheme + f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", "."))]


class Range(InputPartition):
    def __init__(self, path: str, low: int, high: int | None):
        self.path, self.low, self.high = path, low, high


class FastqReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.size, self.columns = int(options.get("rangebytes", 64 << 20)), columns
        self.valid = {"true": True, "false": False}.get(str(options.get("valid")).lower())

    def partitions(self) -> list[Range]:
        names = [x for path in self.paths for x in files_of(path)]
        return [Range(p, low, None if p.endswith(".gz") else min(low + self.size, n)) for p, n in names if n for low in ([0] if p.endswith(".gz") else range(0, n, self.size))]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, path = open_uri(part.path)
        with fs.open_input_file(path) as raw:
            if part.high is None:
                with gzip.open(raw) as lines:
                    yield from self._batches(self._records(lines, part, 0))
                return
            at = max(part.low - 1, 0)
            raw.seek(at)
            lines = io.BufferedReader(raw, 1 << 20)
            if part.low:  # the line that holds the byte before belongs to the range before
                at += len(lines.readline())
            yield from self._batches(self._records(lines, part, at))

    def _batches(self, records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        chosen = [_FIELDS.get_field_index(c) for c in self.columns]
        fields = pa.schema([_FIELDS.field(k) for k in chosen])
        held: list[tuple] = []
        for record in records:
            if self.valid is None or record[5] == self.valid:
                held.append(record)
            if len(held) == _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], fields.field(n).type) for n, k in enumerate(chosen)], schema=fields)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], fields.field(n).type) for n, k in enumerate(chosen)], schema=fields)

    def _records(self, lines, part: Range, at: int) -> Iterator[tuple]:
        ahead: list[tuple[int, str]] = []

        def fill(n: int) -> bool:
            nonlocal at
            while len(ahead) < n and (line := lines.readline()):
                ahead.append((at, line.decode("utf-8", "replace").rstrip("\r\n")))
                at += len(line)
            return len(ahead) >= n

        synced = part.low == 0
        while fill(1) and (part.high is None or ahead[0][0] < part.high):
            if not synced and not (fill(3) and ahead[0][1].startswith("@") and ahead[2][1].startswith("+")):
                ahead.pop(0)
                continue
            synced = True
            if not ahead[0][1].strip():
                ahead.pop(0)
                continue
            fill(4)
            start = ahead[0][0]
            head, seq, plus, quality = ([text for _, text in ahead[:4]] + [""] * 4)[:4]
            good = head.startswith("@") and plus.startswith("+") and 0 < len(seq) == len(quality) and not seq.upper().strip("ACGTN")
            del ahead[:4]
            yield head[1:].strip(), seq.upper(), quality, part.path, start, good, None if good else "\n".join((head, seq, plus, quality)).rstrip("\n")


class PushingReader(FastqReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Broken (or whole) records are left out before they reach Spark; other filters are Spark's."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("valid",) and isinstance(f.value, bool):
                self.valid = f.value
            elif not (isinstance(f, IsNotNull) and f.attribute == ("valid",)):  # it never is null
                yield f


class FastqSource(DataSource):
    """Format ``fastq``: a path (or ``paths``, a JSON list), options ``rangeBytes``, ``columns`` (those wanted, all if not given) and
    ``valid`` (true or false: only such records leave the reader).

    ``_corrupt_record`` is the text of a record that is not valid. With ``pushdown`` true, which needs
    ``spark.sql.python.filterPushdown.enabled``, a filter on ``valid`` is applied while reading.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        wanted = self.options.get("columns")
        return ", ".join(f for f in SCHEMA.split(", ") if not wanted or f.split()[0] in wanted.split(","))

    def reader(self, schema: StructType) -> FastqReader:
        kind = PushingReader if str(self.options.get("pushdown")).lower() == "true" else FastqReader
        return kind(self.options, schema.names)
