"""MGF files as a Python data source: byte ranges for partitions, headers before peaks, nothing lost without a count.

A file is cut into ranges of bytes. A range has the records whose BEGIN IONS line starts in it, so a reader that begins in the middle
of a record skips to the next one, and one that ends in a record reads on. Markers count as whole lines only: a title may hold END IONS.
Lines that begin with #, ;, ! or / are comments; KEY=VALUE lines before the first record are defaults for all records of the file.

Filters on title, precursor_mz, charge and ms_level are decided from the headers; the peaks of other records are not parsed. With option
`skipped` records that can't be used are returned too, without peaks, and status says why: `charge` (not in valid_charge),
`damaged` (no usable PEPMASS, a bad peak, or no END IONS before the next record or the end of the file), else `ok`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

FIELDS = pa.schema([
    ("source_path", pa.string()), ("part", pa.int32()), ("place", pa.int64()), ("title", pa.string()), ("precursor_mz", pa.float64()), ("charge", pa.int16()), ("ms_level", pa.int32()),
    ("annotation", pa.string()), ("peaks", pa.list_(pa.struct([("mz", pa.float64()), ("intensity", pa.float64())]))), ("status", pa.string()),
])
SCHEMA = "source_path string, part int, place long, title string, precursor_mz double, charge short, ms_level int, annotation string, peaks array<struct<mz: double, intensity: double>>, status string"
_PUSHED = ("title", "precursor_mz", "charge", "ms_level")
_COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
#: Bytes of peaks and headers in a batch.
BATCH = 4 << 20


class _Range(InputPartition):
    def __init__(self, path: str, part: int, low: int, high: int) -> None:
        self.path, self.part, self.low, self.high = path, part, low, high


def _header(line: bytes) -> tuple[str, str] | None:
    key, eq, value = line.partition(b"=")
    return (key.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip()) if eq else None


class MgfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.ms_level = int(options.get("mslevel", "2"))
        self.valid = set(json.loads(options["validcharge"])) if options.get("validcharge") else None
        self.skipped = options.get("skipped", "false").lower() == "true"
        self.step = int(options.get("partitionbytes", str(64 << 20)))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name in _PUSHED and (type(f) in _COMPARE or isinstance(f, IsNotNull)):
                self.tests.append((name, type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(path)
        if found.type == fs.FileType.Directory:
            found = [x for x in system.get_file_info(fs.FileSelector(path, recursive=self.recursive)) if x.is_file and x.base_name[0] not in "._" and (not self.recursive or x.extension == "mgf")]
        else:
            found = [found] if found.is_file else []
        return [_Range(x.path, i, low, min(low + self.step, x.size)) for x in sorted(found, key=lambda x: x.path) for i, low in enumerate(range(0, x.size, self.step))] or [_Range("", 0, 0, 0)]

    def _wanted(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            if row[name] is None or (kind is not IsNotNull and not _COMPARE[kind](row[name], value)):
                return False
        return True

    def _row(self, part: _Range, place: int, params: dict[str, str]) -> dict:
        """A record by its headers."""
        mz, charge, level = None, 0, self.ms_level
        status = "ok"
        if digits := re.search(r"\d+", params.get("mslevel", "")):
            level = int(digits[0])
        if self.ms_level > 1:
            if digits := re.search(r"(\d+)([+-]?)", params.get("charge", "")):
                charge = min(int(digits[1]), 32767) * (-1 if digits[2] == "-" else 1)
            try:
                mz = float(params.get("pepmass", "").split()[0])
            except (IndexError, ValueError):
                status = "damaged"
            if status == "ok" and self.valid is not None and charge not in self.valid:
                status = "charge"
        return {"source_path": part.path, "part": part.part, "place": place, "title": params.get("title"), "precursor_mz": mz, "charge": charge, "ms_level": level, "annotation": params.get("seq") or None, "peaks": None, "status": status}

    def _records(self, part: _Range, f: _Lines) -> Iterator[dict]:
        """Rows of the records that begin in a range; peaks are a flat list, m/z and intensity in turn."""
        defaults: dict[str, str] = {}
        for line in f:
            if line.strip() == b"BEGIN IONS":
                break
            if line[:1] not in b"#;!/" and (kv := _header(line)):
                defaults[kv[0]] = kv[1]
        at = max(part.low - 1, 0)
        f.seek(at)
        if part.low:
            at += len(f.readline())
        place = 0
        row = params = None  # of the record that is open; params until its first peak

        def ended(sound: bool) -> Iterator[dict]:
            nonlocal place
            if params is not None:
                done = self._row(part, place, params)
                done["peaks"] = []
            else:
                done = row
            if not sound:
                done["status"] = "damaged"
            if done["status"] != "ok":
                done["peaks"] = None
            place += 1
            if self._wanted(done) and (self.skipped or done["status"] == "ok"):
                yield done

        use = False
        while line := f.readline():
            text = line.strip()
            if text == b"BEGIN IONS":
                if row is not None or params is not None:
                    yield from ended(False)
                    row = params = None
                if at >= part.high:
                    return
                params = dict(defaults)
            elif row is None and params is None:
                if at >= part.high:
                    return
            elif text == b"END IONS":
                yield from ended(True)
                row = params = None
            elif text and text[:1] not in b"#;!/":
                if params is not None:
                    if b"=" in text and text[:1].isalpha() and (kv := _header(text)):
                        params[kv[0]] = kv[1]
                    else:
                        row, params = self._row(part, place, params), None
                        row["peaks"] = []
                        use = row["status"] == "ok" and self._wanted(row)  # else its peaks are passed over
                if row is not None and use:
                    try:
                        mz, intensity = map(float, text.split()[:2])
                        row["peaks"] += mz, intensity
                    except ValueError:
                        row["status"], use = "damaged", False
            at += len(line)
        if row is not None or params is not None:
            yield from ended(False)

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        rows, held = [], 0
        with system.open_input_file(partition.path) as f:
            for r in self._records(partition, _Lines(f)):
                rows.append(r)
                held += 200 + 16 * len(r["peaks"] or ())
                if held > BATCH:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    """Rows of _records as Arrow, their peaks without an object for each."""
    peaks = [r["peaks"] for r in rows]
    flat = np.fromiter((x for p in peaks for x in p or ()), np.float64).reshape(-1, 2)
    ends = np.cumsum([0, *(len(p or ()) // 2 for p in peaks)], dtype=np.int32)
    kind = FIELDS.field("peaks").type
    values = pa.StructArray.from_arrays([np.ascontiguousarray(flat[:, 0]), np.ascontiguousarray(flat[:, 1])], fields=list(kind.value_type))
    lists = pa.ListArray.from_arrays(pa.array(ends), values, type=kind, mask=pa.array([p is None for p in peaks]))
    return pa.RecordBatch.from_arrays([lists if f.name == "peaks" else pa.array([r[f.name] for r in rows], f.type) for f in FIELDS], schema=FIELDS)


class _Lines:
    """Buffered lines of a file that can be read from any place. A line costs its own bytes; what is left of the buffer is copied once for each read of the file."""

    def __init__(self, f: pa.NativeFile, size: int = 1 << 20) -> None:
        self.f, self.size = f, size
        self.rest, self.at, self.over = b"", 0, False

    def seek(self, at: int) -> None:
        self.f.seek(at)
        self.rest, self.at, self.over = b"", 0, False

    def readline(self) -> bytes:
        end = self.rest.find(b"\n", self.at)
        while end < 0 and not self.over:
            more = self.f.read(self.size)
            self.over = not more
            start = len(self.rest) - self.at
            self.rest, self.at = self.rest[self.at :] + more, 0
            end = self.rest.find(b"\n", start)
        cut = end + 1 if end >= 0 else len(self.rest)
        line = self.rest[self.at : cut]
        self.at = cut
        return line

    def __iter__(self) -> Iterator[bytes]:
        while line := self.readline():
            yield line


class MgfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "peakforge_mgf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MgfReader:
        return MgfReader(self.options)


def scan_mgf(spark: SparkSession, path: str, ms_level: int = 2, valid_charge: tuple[int, ...] | None = tuple(range(1, 11)), skipped: bool = False, recursive: bool = False, partition_bytes: int = 64 << 20) -> DataFrame:
    """The records of a file or folder. part and place order the records of a file; at MS level 1 there is no precursor and no charge filter."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MgfSource)
    reader = spark.read.format("peakforge_mgf").option("msLevel", ms_level).option("skipped", skipped).option("recursive", recursive).option("partitionBytes", partition_bytes)
    if valid_charge is not None and ms_level > 1:
        reader = reader.option("validCharge", json.dumps(list(valid_charge)))
    return reader.load(path)


def skip_counts(records: DataFrame) -> DataFrame:
    """Per file of a scan with skipped=True: how many records are sound, damaged, or of another charge, and the peaks of the sound ones."""
    n = lambda s: F.count_if(F.col("status") == s)
    return records.groupBy("source_path").agg(n("ok").alias("n_spectra"), n("damaged").alias("n_damaged"), n("charge").alias("n_charge"), F.coalesce(F.sum(F.size("peaks")), F.lit(0)).cast("long").alias("n_peaks"))
