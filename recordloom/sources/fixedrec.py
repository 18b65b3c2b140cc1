"""Fixed-length record files as a Spark data source, with ingest policies checked before any record is read.

``spark.read.format("fixedrec")`` splits a file into ranges of whole records; each task seeks to its range. Ranges have ``split_bytes``, or more
where that would make over MOST_RANGES of them. ``first`` and ``last`` narrow
the ranges. They are options and no pushed filters, as Spark 4.1 keeps one reader for all uses of a Python relation: after a
filtered use, others of the same frame or view would get the narrowed reader and lose rows. A folder stands for its files in the order of their names: records are numbered through, offsets
are those in their file, and the policy holds for each file. Files are opened through Arrow's file systems, so a path may be
local or a store's URI.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from enum import IntEnum

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "record_index long, raw_offset long, raw_len int, partial boolean, record binary"
SPLIT_BYTES = 64 << 20
#: Ranges that a read is split into at most, while they stay below SPLIT_BYTES: a task for each few records costs more than they do.
MOST_RANGES = 128
_READ_BYTES = 4 << 20


class ExitCode(IntEnum):
    """What a command ends with."""

    SUCCESS = 0
    EVIDENCE_WARNINGS = 1
    STRICT_FAILURE = 2
    UNSUPPORTED = 3
    BAD_LAYOUT = 4
    INTERNAL = 5
    UNREADABLE = 5  # another name of the same: no such file, or a setting that can't be used


class IngestError(ValueError):
    """A file that the policy refuses; code is the exit code."""

    def __init__(self, message: str, code: ExitCode = ExitCode.STRICT_FAILURE):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Policy:
    """record_len; newline is reject, allow (a final line feed is dropped) or strip (dropped and told); partial is reject or evidence."""

    record_len: int
    newline: str = "reject"
    partial: str = "reject"

    def __post_init__(self):
        if self.record_len <= 0:
            raise IngestError("record_len must be above 0", ExitCode.INTERNAL)
        if self.newline not in ("reject", "allow", "strip") or self.partial not in ("reject", "evidence"):
            raise IngestError("unknown policy", ExitCode.INTERNAL)


@dataclass(frozen=True)
class Span:
    """What a file holds under a policy: bytes that count, whole records, length of a partial one, whether a line feed went."""

    length: int
    records: int
    tail: int
    stripped: bool


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def open_file(path: str):
    fs, at = _at(path)
    return fs.open_input_file(at)


def files_of(path: str) -> list[str]:
    """The file itself, or the files of a folder by name, without those that begin with a dot or an underscore."""
    fs, at = _at(path)
    if fs.get_file_info(at).type != pafs.FileType.Directory:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(at))
    return [f"{path.rstrip('/')}/{name}" for name in sorted(f.base_name for f in found if f.type == pafs.FileType.File) if name[0] not in "._"]


def examine(path: str, policy: Policy) -> Span:
    """Applies the policy to the file's length and last byte; raises IngestError where it refuses."""
    with open_file(path) as f:
        size = f.size()
        last = b""
        if size and size % policy.record_len == 1:
            f.seek(size - 1)
            last = f.read(1)
    stripped = False
    if last == b"\n" and size % policy.record_len == 1 and size > 1:
        if policy.newline == "reject":
            raise IngestError("the file ends with a line feed after its last record")
        size, stripped = size - 1, policy.newline == "strip"
    tail = size % policy.record_len
    if tail and policy.partial == "reject":
        raise IngestError(f"the last record has {tail} of {policy.record_len} bytes")
    return Span(size, size // policy.record_len, tail, stripped)


@dataclass
class Range(InputPartition):
    path: str
    before: int
    first: int
    count: int
    tail: int


def range_records(total: int, split: int, n: int) -> int:
    """Records to a range, of n bytes each: of ``split`` bytes, or more where all ``total`` bytes would make too many ranges."""
    return max(1, max(split, min(SPLIT_BYTES, total // MOST_RANGES)) // n)


def read_range(part: Range, n: int) -> Iterator[pa.RecordBatch]:
    """The records of a range, n bytes each; the last may be a tail of fewer."""
    if not part.count:
        return
    step = max(1, _READ_BYTES // n)
    with open_file(part.path) as f:
        f.seek(part.first * n)
        for a in range(part.first, part.first + part.count, step):
            k = min(step, part.first + part.count - a)
            last = a + k == part.first + part.count
            data = f.read(k * n if not (last and part.tail) else (k - 1) * n + part.tail)
            ends = np.minimum(np.arange(k + 1, dtype=np.int64) * n, len(data))
            index, size = np.arange(a, a + k, dtype=np.int64), np.diff(ends).astype(np.int32)
            cut = pa.Array.from_buffers(pa.large_binary(), k, [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(index + part.before), pa.array(index * n), pa.array(size), pa.array(size < n), cut],
                ["record_index", "raw_offset", "raw_len", "partial", "record"],
            )


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.policy = Policy(int(options["record_len"]), options.get("newline", "reject"), options.get("partial", "reject"))
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.low, self.high = int(options.get("first", 0)), int(options["last"]) if "last" in options else None

    def partitions(self):
        spans, out, before = [(path, examine(path, self.policy)) for path in files_of(self.path)], [], 0
        step = range_records(sum(span.length for _, span in spans), self.split, self.policy.record_len)
        for path, span in spans:
            n = span.records + (span.tail > 0)
            low, high = max(self.low - before, 0), n - 1 if self.high is None else min(self.high - before, n - 1)
            out += [Range(path, before, a, min(step, high + 1 - a), span.tail if a + step > high and high == n - 1 else 0) for a in range(low, high + 1, step)]
            before += n
        return out or [Range(self.path, 0, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return read_range(part, self.policy.record_len)


class FixedRecordSource(DataSource):
    """Options: path, record_len, newline, partial, split_bytes, first, last (numbers of records)."""

    @classmethod
    def name(cls) -> str:
        return "fixedrec"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, overwrite)


@dataclass
class _Written(WriterCommitMessage):
    """A task's file: its place among the others, its name in the staging folder, its records and bytes."""

    place: int
    name: str
    records: int
    bytes: int


class _Writer(DataSourceArrowWriter):
    """Writes each task's records to a file in a staging folder; the job's commit moves the files in, its abort removes them.

    A task that is killed or run again leaves nothing that is read: readers skip the staging folder, and only files that
    a finished task has told are moved. The last thing written is _SUCCESS, which lists the files.
    """

    def __init__(self, options: dict, schema, overwrite: bool):
        if "record" not in schema.names:
            raise IngestError("there is no column record to write", ExitCode.UNREADABLE)
        self.folder, self.overwrite, self.prefix = options["path"].rstrip("/"), overwrite, options.get("prefix", "part")
        self.job = uuid.uuid4().hex
        self.staging = f"{self.folder}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        fs, at = _at(self.staging)
        fs.create_dir(at, recursive=True)
        name, records, size = f"{task.partitionId():06}-{uuid.uuid4().hex}", 0, 0
        with fs.open_output_stream(f"{at}/{name}") as out:
            for batch in iterator:
                for record in batch.column("record").to_pylist():
                    if record is not None:
                        out.write(record)
                        records, size = records + 1, size + len(record)
        return _Written(task.partitionId(), name, records, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, to = _at(self.folder)
        _, staged = _at(self.staging)
        fs.create_dir(to, recursive=True)
        before = [] if not self.overwrite else [f.path for f in fs.get_file_info(pafs.FileSelector(to)) if f.type == pafs.FileType.File]
        for path in before:
            fs.delete_file(path)
        files = []
        for m in sorted((m for m in messages if m is not None and m.records), key=lambda m: m.place):
            name = f"{self.prefix}-{m.place:06}.dat"
            fs.move(f"{staged}/{m.name}", f"{to}/{name}")
            files.append({"file": name, "records": m.records, "bytes": m.bytes})
        with fs.open_output_stream(f"{to}/_SUCCESS") as out:
            out.write(json.dumps({"job": self.job, "files": files}).encode())
        self._clean(fs, staged)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean(*_at(self.staging))

    @staticmethod
    def _clean(fs: pafs.FileSystem, staged: str) -> None:
        if fs.get_file_info(staged).type == pafs.FileType.Directory:
            fs.delete_dir(staged)


def save_records(df: DataFrame, folder: str, files: int | None = None, mode: str = "append", prefix: str = "part") -> DataFrame:
    """Saves the records (record_index, record) in order as a folder that ``read_records`` numbers through; all files or none.

    Returns file, records, bytes of what this job wrote. Null records aren't written. ``append`` adds to what is there, under a
    prefix of its own; ``overwrite`` removes it when the new files are complete.
    """
    spark = df.sparkSession
    spark.dataSource.register(FixedRecordSource)
    rows = df.select("record_index", "record")
    rows = rows.repartitionByRange(files, "record_index") if files else rows.repartitionByRange("record_index")
    rows.sortWithinPartitions("record_index").select("record").write.format("fixedrec").mode(mode).option("path", folder).option("prefix", prefix).save()
    with open_file(f"{folder.rstrip('/')}/_SUCCESS") as f:
        told = json.loads(f.read())
    return spark.createDataFrame([(x["file"], x["records"], x["bytes"]) for x in told["files"]], "file string, records long, bytes long")


def read_records(spark: SparkSession, path: str, policy: Policy, split_bytes: int = SPLIT_BYTES, first: int = 0, last: int | None = None) -> DataFrame:
    """record_index, raw_offset, raw_len, partial, record of a file or a folder; refused files raise before a plan is made.

    With first and last only the bytes of these records and those between are read.
    """
    for at in files_of(path):
        examine(at, policy)
    spark.dataSource.register(FixedRecordSource)
    ends = {"first": first} | ({} if last is None else {"last": last})
    return spark.read.format("fixedrec").options(path=path, record_len=policy.record_len, newline=policy.newline, partial=policy.partial, split_bytes=split_bytes, **ends).load()


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path in the folder that all executors share; one on this machine only where nothing else is used."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="recordloom-")
    at = f"file://{at[5:]}" if at.startswith("file:/") and not at.startswith("file://") else at
    return f"{at.rstrip('/')}/recordloom-{label}-{uuid.uuid4().hex}"


def write_records(df: DataFrame, folder: str, files: int | None = None, prefix: str = "part") -> DataFrame:
    """Writes the records (record_index, record) in order to a folder of files that ``read_records`` numbers through.

    Each task writes a range of record_index to a file of its own and renames it when it is whole, so a task that is run again
    writes the same file. Returns file, records, bytes of each; nothing but these passes through the driver.
    """
    folder = folder.rstrip("/")
    fs, at = _at(folder)
    fs.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _at(folder)
        name, part, n, size, out = None, f"{at}/_{uuid.uuid4().hex}", 0, 0, None
        for batch in batches:
            records = batch.column(1).to_pylist()
            if out is None and records:
                name, out = f"{prefix}-{batch.column(0)[0].as_py():06}.dat", fs.open_output_stream(part)
            if records:
                out.write(data := b"".join(records))
                n, size = n + len(records), size + len(data)
        if out is not None:
            out.close()
            fs.move(part, f"{at}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    rows = df.select("record_index", "record")
    rows = rows.repartitionByRange(files, "record_index") if files else rows.repartitionByRange("record_index")
    rows = rows.sortWithinPartitions("record_index").select(F.spark_partition_id().alias("place"), "record")
    made = rows.mapInArrow(run, "file string, records long, bytes long").collect()  # a row for each file
    return df.sparkSession.createDataFrame(sorted(map(tuple, made)), "file string, records long, bytes long")


def nth_record(spark: SparkSession, path: str, policy: Policy, index: int) -> DataFrame:
    """The record of that number, or no row; its bytes alone are read."""
    return read_records(spark, path, policy, first=index, last=index)


def _judged(path: str, policy: Policy) -> tuple[Span, ExitCode, str]:
    """What a file holds, its exit code and why. A path that can't be read is told, not raised."""
    none = Span(0, 0, 0, False)
    try:
        span = examine(path, policy)
    except IngestError as e:
        return none, e.code, str(e)
    except OSError as e:
        return none, ExitCode.UNREADABLE, f"the file can't be read: {e.strerror or e}"
    return (span, ExitCode.EVIDENCE_WARNINGS, "a partial record is kept as evidence") if span.tail else (span, ExitCode.SUCCESS, "")


_MANIFEST = "path string, record_len int, record_count long, newline_policy string, partial_policy string, first_offset long, last_offset long, partial boolean, stripped_line_feed boolean, exit_code int, reason string"


def file_manifest(spark: SparkSession, path: str, policy: Policy) -> DataFrame:
    """A row for each file: sha256, length, counts, policies, first and last offset (-1 where empty), verdict.

    A folder has a row for each of its files, none if it is empty. A path that isn't there or can't be read has exit code 5 and no
    digest. Each digest streams its file once, files side by side.
    """
    rows = []
    for at in files_of(path):
        span, code, why = _judged(at, policy)
        n = span.records + (span.tail > 0)
        rows.append((at, policy.record_len, n, policy.newline, policy.partial, 0 if n else -1, (n - 1) * policy.record_len if n else -1, span.tail > 0, span.stripped, int(code), why))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes = [], []
            for at, code in zip(batch.column("path").to_pylist(), batch.column("exit_code").to_pylist(), strict=True):
                h, n = hashlib.sha256(), 0
                if code != ExitCode.UNREADABLE:
                    with open_file(at) as f:
                        while data := f.read(_READ_BYTES):
                            h.update(data)
                            n += len(data)
                hashes.append(h.hexdigest() if code != ExitCode.UNREADABLE else None)
                sizes.append(n if code != ExitCode.UNREADABLE else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.string()), pa.array(sizes, pa.int64())], [*batch.schema.names, "sha256", "file_bytes"])

    made = spark.createDataFrame(rows, _MANIFEST).repartition(max(1, len(rows)), "path").mapInArrow(digest, _MANIFEST + ", sha256 string, file_bytes long")
    return made.select("path", "sha256", "file_bytes", *(c.split(" ")[0] for c in _MANIFEST.split(", ")[1:]))
