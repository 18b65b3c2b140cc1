"""Records of files that arrive in a folder, as a stream with the numbers and offsets of a batch read of the same folder.

Files are read in the order of their names, so what arrives must have a later name than all before it (a date, a number); the last
one may still grow. The stream's offset is a file and a byte in it, with what stood before: the number of files, their bytes and the
records. It is all that is needed to go on after a restart, and to notice files that came late, shrank or grew after
their turn, which stop the stream instead of being skipped or read twice. A batch reads each file in ranges of whole records.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from recordloom.sources import fixedrec
from recordloom.sources.fixedrec import IngestError, Policy, Range

#: Whether the last file may still grow, or files arrive whole (moved into the folder when they are written).
GROWING = ("last", "none")


@dataclass(frozen=True)
class Arrival:
    """A file by name: its bytes, and what stands before it."""

    name: str
    size: int
    files: int
    bytes: int
    records: int


def _listed(folder: str) -> list[tuple[str, int]]:
    """Name and size of the folder's files by name, without those that begin with a dot or an underscore."""
    fs, at = fixedrec._at(folder)
    found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._")


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.policy = Policy(int(options["record_len"]), options.get("newline", "reject"), options.get("partial", "reject"))
        self.split = int(options.get("split_bytes", fixedrec.SPLIT_BYTES))
        self.growing = options.get("growing", "last")
        if self.growing not in GROWING:
            raise IngestError(f"growing is {self.growing}, not one of {GROWING}", fixedrec.ExitCode.INTERNAL)

    def initialOffset(self) -> dict:
        return {"file": "", "byte": 0, "files": 0, "bytes": 0, "records": 0}

    def _arrivals(self, start: dict) -> list[Arrival]:
        """The files from the start's on; raises where what the start has seen is no longer so."""
        listed = _listed(self.folder)
        done = [x for x in listed if x[0] < start["file"]]
        if (len(done), sum(n for _, n in done)) != (start["files"], start["bytes"]):
            raise IngestError(f"files before {start['file']} have changed or arrived late: {len(done)} files, {sum(n for _, n in done)} bytes instead of {start['files']}, {start['bytes']}")
        out, files, size, records = [], start["files"], start["bytes"], start["records"]
        for name, n in listed[len(done) :]:
            if name == start["file"] and n < start["byte"]:
                raise IngestError(f"{name} shrank to {n} bytes, of which {start['byte']} were read")
            out.append(Arrival(name, n, files, size, records))
            files, size = files + 1, size + n
            if name != listed[-1][0]:
                span = self._span(name, n)
                records += span.records + (span.tail > 0)
        if start["file"] and (not out or out[0].name != start["file"]):
            raise IngestError(f"{start['file']} is gone")
        return out

    def _span(self, name: str, size: int) -> fixedrec.Span:
        """What a closed file holds; only files that don't end with a record are opened for that."""
        n = self.policy.record_len
        return fixedrec.examine(f"{self.folder}/{name}", self.policy) if size % n else fixedrec.Span(size, size // n, 0, False)

    def _end(self, a: Arrival, closed: bool) -> int:
        """The byte up to which a file counts: its whole records while it may grow."""
        return self._span(a.name, a.size).length if closed else a.size - a.size % self.policy.record_len

    def latestOffset(self) -> dict:
        arrivals = self._arrivals(self.initialOffset())
        if not arrivals:
            return self.initialOffset()
        last = arrivals[-1]
        return {"file": last.name, "byte": self._end(last, self.growing == "none"), "files": last.files, "bytes": last.bytes, "records": last.records}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        n, out = self.policy.record_len, []
        arrivals = self._arrivals(start)
        step = fixedrec.range_records(sum(a.size for a in arrivals if a.name <= end["file"]), self.split, n)
        for a in arrivals:
            if a.name > end["file"]:
                break
            if a.name == end["file"] and (a.files, a.bytes, a.records) != (end["files"], end["bytes"], end["records"]):
                raise IngestError(f"files before {a.name} have changed or arrived late")
            upto = end["byte"] if a.name == end["file"] else self._end(a, True)
            first, tail = (start["byte"] // n if a.name == start["file"] else 0), upto % n
            count = -(-upto // n)
            if a.name == start["file"] and start["byte"] % n:
                if upto != start["byte"]:
                    raise IngestError(f"{a.name} grew after its last record was read as partial")
                continue
            out += [Range(f"{self.folder}/{a.name}", a.records, r, min(step, count - r), tail if r + step >= count else 0) for r in range(first, count, step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return fixedrec.read_range(part, self.policy.record_len)


class ArrivingRecords(DataSource):
    """Options: path (a folder), record_len, newline, partial, split_bytes, growing (last or none)."""

    @classmethod
    def name(cls) -> str:
        return "fixedrec_arrivals"

    def schema(self) -> str:
        return fixedrec.SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def record_stream(spark: SparkSession, folder: str, policy: Policy | int, growing: str = "last", split_bytes: int = fixedrec.SPLIT_BYTES) -> DataFrame:
    """record_index, raw_offset, raw_len, partial, record of all files of a folder, as they arrive in the order of their names.

    Line ends and partial records are judged by the policy (or a record length, with the strict one) when a file is closed: a later one
    is there, or ``growing`` is none.
    """
    policy = Policy(policy) if isinstance(policy, int) else policy
    spark.dataSource.register(ArrivingRecords)
    return spark.readStream.format("fixedrec_arrivals").options(path=folder, record_len=policy.record_len, newline=policy.newline, partial=policy.partial, growing=growing, split_bytes=split_bytes).load()
