"""Custody: record-order hash chains, sequence checks, and chains of batch seals."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from recordloom.functions.decode import ASCII, typed, valid
from recordloom.operators.findings import FINDING, finding
from recordloom.plans.copybook import Layout
from recordloom.sources.fixedrec import files_of, new_folder, open_file

GENESIS = ""
#: Parts two fields of a seal.
UNIT = "\x1e"


def ordered_files(df: DataFrame, order: str, ranges: int | None = None) -> list[str]:
    """df in order, as files of the shared folder that follow each other: sorted by ranges, each row written once.

    Rows of equal order come by their other columns, so that the files don't depend on how df was partitioned.
    """
    folder = new_folder(df.sparkSession, "ordered")
    placed = df.repartitionByRange(ranges, order) if ranges else df.repartitionByRange(order)
    placed.sortWithinPartitions(order, *(c for c in df.columns if c != order)).write.parquet(folder)
    return files_of(folder)


def file_batches(files: list[str], columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of some files, file after file and a batch at a time. The next batch is read while the last one is worked on."""

    def read() -> Iterator[pa.RecordBatch]:
        for path in files:
            with open_file(path) as f:
                yield from pq.ParquetFile(f).iter_batches(8192, columns=columns)

    batches = read()
    with ThreadPoolExecutor(1) as reader:
        ahead = reader.submit(next, batches, None)
        while (batch := ahead.result()) is not None:
            ahead = reader.submit(next, batches, None)
            yield batch


def _bytes_of(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all texts or records of a column, as they lie, and where each begins, with the end of the last; a null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")  # a batch may have over 2 GB
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, "<i8")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, "<i8")
    return memoryview(data or b"")[ends[0] : ends[-1]], ends - ends[0]


def streamed(spark: SparkSession, files: list[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, columns: list[str] | None = None) -> DataFrame:
    """run over all rows of ordered files in one task, which holds two batches: for states that pass from each row to the next."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names in batch.column(0).to_pylist():
                yield from run(file_batches(names, columns))

    one = spark.sparkContext.parallelize([(files,)], 1)  # a coalesce(1) would let a union put two such tasks into one
    return spark.createDataFrame(one, "files array<string>").mapInArrow(task, schema)


def ordered_records(df: DataFrame, order: str, record: str, ranges: int | None = None) -> list[str]:
    """Records (or texts) in order as files of one column r, equal numbers by their bytes; chains and digests stream them."""
    return ordered_files(df.select(F.col(order).alias("o"), F.col(record).cast("binary").alias("r")), "o", ranges)


def file_chain(spark: SparkSession, files: list[str], column: str = "r") -> DataFrame:
    """hash, records: the chain over all records of ordered files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, n = "", 0
        for batch in batches:
            data, ends = _bytes_of(batch.column(0))
            data, ends = data.tobytes(), ends.tolist()
            for a, b in pairwise(ends):
                state = hashlib.sha256(state.encode() + data[a:b]).hexdigest()
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"hash": [state], "records": pa.array([n], pa.int64())})

    return streamed(spark, files, run, "hash string, records long", [column])


def record_chain(df: DataFrame, order: str = "record_index", record: str = "record", most: int | None = None) -> DataFrame:
    """hash, records: h0 = sha256(r0), then sha256(hex of the hash so far, then the record), in order of ``order`` (equal ones by their bytes).

    Records are sorted by ranges, of at most about ``most`` records where that is given. Each link needs the one before, so one
    task then streams the ranges.
    """
    ranges = -(-df.count() // most) or 1 if most else None
    return file_chain(df.sparkSession, ordered_records(df, order, record, ranges))


def chain_in_row(records: Column) -> Column:
    """The same chain over an ordered array of binaries, for units that fit a row."""
    return F.aggregate(records, F.lit(""), lambda h, r: F.sha2(F.concat(h.cast("binary"), r), 256))


def unit_chains(df: DataFrame, unit: str, order: str = "record_index", record: str = "record") -> DataFrame:
    """unit, hash, records: a chain of its own for each unit, all units at once.

    A unit's records are sorted in one task and streamed from there, so a large unit takes time, as its links need each other, but
    no memory. A null unit is one.
    """
    kind = df.schema[unit].dataType
    schema = StructType([StructField(unit, kind), StructField("hash", StringType()), StructField("records", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, n = None, "", 0
        for batch in batches:
            units, done = batch.column(0), []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                here = units[i]
                if n and here.as_py() != at.as_py():
                    done.append((at, state, n))
                    state, n = "", 0
                at, state, n = here, hashlib.sha256(state.encode() + (raw or b"")).hexdigest(), n + 1
            if done:
                yield made(done, units.type)
        if n:
            yield made([(at, state, n)], units.type)

    def made(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        at, state, n = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in at], kind), pa.array(state), pa.array(n, pa.int64())], [unit, "hash", "records"])

    rows = df.select(F.col(unit).alias("u"), F.col(record).cast("binary").alias("r"), F.col(order).alias("o"))
    return rows.repartition("u").sortWithinPartitions("u", "o", "r").select("u", "r").mapInArrow(run, schema)


def file_digest(spark: SparkSession, files: list[str], column: str) -> DataFrame:
    """hash, records: sha256 over all texts of ordered files, each with a line feed after it. Texts are hashed as they lie in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n = hashlib.sha256(), 0
        kind = pa.large_binary()
        none, end = pa.scalar(b"", kind), pa.scalar(b"\n", kind)
        for batch in batches:
            texts = pc.fill_null(batch.column(0).cast(kind), b"")
            digest.update(_bytes_of(pc.binary_join_element_wise(texts, none, end))[0])
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"hash": [digest.hexdigest()], "records": pa.array([n], pa.int64())})

    return streamed(spark, files, run, "hash string, records long", [column])


def ordered_digest(df: DataFrame, order: str, text: str) -> DataFrame:
    """hash, records: sha256 over all texts in order, each with a line feed after it, texts of equal order by their bytes.

    The rows are sorted by ranges. A digest's state can't leave a task, so one task streams the ranges, a batch at a time.
    """
    return file_digest(df.sparkSession, ordered_records(df.select(F.col(order).alias("o"), F.col(text).cast("string").alias("t")), "o", "t"), "r")


def sequence_words(df: DataFrame, seq: str) -> DataFrame:
    """w, bits, n: a sequence set as words of 64 values from 64 w on, a bit for each value that occurs, and how many rows have one.

    One hash aggregation on longs, with partial sums before the shuffle: no value is sorted, and what is shuffled is a
    row for each task and word.
    """
    v = F.col("v")
    return df.where(F.col(seq).isNotNull()).select(F.col(seq).cast("long").alias("v")).groupBy(F.shiftright(v, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(v & 63 AS int))")).alias("bits"), F.count("*").alias("n"))


def sequence_duplicates(df: DataFrame, seq: str) -> DataFrame:
    """value, times of sequence values that occur more than once.

    Only values of words that have more rows than bits are counted one by one.
    """
    words = sequence_words(df, seq).where(F.col("n") > F.bit_count("bits")).select("w")
    values = df.where(F.col(seq).isNotNull()).withColumn("w", F.shiftright(F.col(seq).cast("long"), 6))
    return values.join(words, "w", "left_semi").groupBy(F.col(seq).alias("value")).agg(F.count("*").alias("times")).where("times > 1")


def _bucket_gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """first, last of the missing runs between a bucket's values, and as b, lo, hi its number and outermost values."""
    for batch in batches:
        out = []
        for b, words in zip(batch.column("b").to_pylist(), batch.column("words"), strict=True):
            bits = np.zeros(1 << 9, "<i8")
            bits[words.values.field("w").to_numpy() - (b << 9)] = words.values.field("bits").to_numpy()
            found = np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little")) + (b << 15)
            cut = np.flatnonzero(np.diff(found) > 1)
            out.append((b, int(found[0]), int(found[-1]), [{"first": f, "last": t} for f, t in zip((found[cut] + 1).tolist(), (found[cut + 1] - 1).tolist(), strict=True)]))
        if out:
            runs = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), runs), strict=True)], ["b", "lo", "hi", "gaps"])


def sequence_gaps(df: DataFrame, seq: str) -> DataFrame:
    """first, last of each run of values that are missing between two that occur.

    Words of 64 values are gathered into buckets of 512 words, in each of which a task finds the gaps. Gaps between buckets come
    from their outermost values: neighbours are compared within groups of 32,768 buckets, then within groups of such groups, so
    every step sees a bounded number of rows at a time and none sees the values.
    """
    word = F.struct("w", "bits")
    buckets = sequence_words(df, seq).groupBy(F.shiftright("w", 9).alias("b")).agg(F.collect_list(word).alias("words"))
    buckets = buckets.mapInArrow(_bucket_gaps, "b long, lo long, hi long, gaps array<struct<first:bigint,last:bigint>>").checkpoint()
    out = buckets.select(F.explode("gaps").alias("g")).select("g.*")
    edges = buckets.select("b", "lo", "hi")
    for group in (*[F.shiftright("b", 15)] * 3, F.lit(0)):  # 49 bits of bucket numbers; the last step sees 16 rows at most
        after = F.lead("lo").over(Window.partitionBy(group).orderBy("b"))
        between = edges.select(F.when(after.isNotNull(), F.col("hi") + 1).alias("first"), (after - 1).alias("last"))
        out = out.union(between.where("first <= last"))
        edges = edges.groupBy(group.alias("b")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return out


def repeated_ids(df: DataFrame, ident: str, order: str = "record_index") -> DataFrame:
    """value, at: ids that occur again, and where they do so first."""
    w = Window.partitionBy(ident).orderBy(order)
    again = df.where(F.col(ident).isNotNull()).select(F.col(ident).alias("value"), F.col(order).alias("at"), F.row_number().over(w).alias("n"))
    return again.where("n = 2").select("value", "at")


@dataclass(frozen=True)
class PostingSpec:
    """A posting unit: its id, the fields of sequence and transaction id, and whether sequences have no gap."""

    unit_id: str
    sequence: str
    transaction: str | None = None
    contiguous: bool = False


def posting_findings(df: DataFrame, layout: Layout, spec: PostingSpec, encoding: str = ASCII) -> DataFrame:
    """Findings on a posting unit's sequences and transaction ids; df has record_index and record."""
    if not spec.unit_id:
        raise ValueError("a posting unit needs an id")
    if not layout.has(spec.sequence):
        return df.limit(0).select(finding("POSTING-NO-SEQUENCE", F.lit("")).alias("f")).select("f.*").union(df.sparkSession.createDataFrame([("POSTING-NO-SEQUENCE", "warning", f"no field {spec.sequence}", None)], FINDING))
    seq = layout.field(spec.sequence)
    cols = {"seq": typed(seq, encoding).cast("decimal(38,0)"), "ok": valid(seq, encoding)}
    if spec.transaction:
        cols["txn"] = typed(layout.field(spec.transaction), encoding)
    rows = df.select("record_index", *(c.alias(k) for k, c in cols.items()))
    out = rows.where("not ok").select(finding("POSTING-DIRTY-SEQUENCE", F.lit("sequence is not a valid number"), "record_index").alias("f")).select("f.*")
    twice = sequence_duplicates(rows.where("ok"), "seq")
    out = out.union(twice.select(finding("POSTING-DUPLICATE-SEQUENCE", F.concat(F.lit("sequence "), F.col("value").cast("string"), F.lit(" occurs "), F.col("times").cast("string"), F.lit(" times"))).alias("f")).select("f.*"))
    if spec.contiguous:
        gaps = sequence_gaps(rows.where("ok"), "seq")
        out = out.union(gaps.select(finding("POSTING-SEQUENCE-GAP", F.concat(F.lit("missing "), F.col("first").cast("string"), F.lit(" to "), F.col("last").cast("string"))).alias("f")).select("f.*"))
    if spec.transaction:
        again = repeated_ids(rows, "txn")
        out = out.union(again.select(finding("POSTING-DUPLICATE-TXN-ID", F.concat(F.lit("transaction "), F.col("value").cast("string"), F.lit(" occurs again")), "at").alias("f")).select("f.*"))
    return out


def posting_manifest(df: DataFrame, layout: Layout, spec: PostingSpec, encoding: str = ASCII) -> DataFrame:
    """unit_id, records, last_hash, first_seq, last_seq, findings of a unit."""
    seq = F.lit(None).cast("decimal(38,0)") if not layout.has(spec.sequence) else typed(layout.field(spec.sequence), encoding).cast("decimal(38,0)")
    span = df.agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"))
    count = posting_findings(df, layout, spec, encoding).agg(F.count("*").alias("findings"))
    chain = record_chain(df)
    return chain.crossJoin(span).crossJoin(count).select(F.lit(spec.unit_id).alias("unit_id"), "records", F.col("hash").alias("last_hash"), "first_seq", "last_seq", "findings")


def _seal(before: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(UNIT, *(p.cast("string") for p in parts), before).cast("binary"), 256)


SEALED = ("batch_id", "input_hash", "control_hash", "output_hash")


def seal_chain(batches: DataFrame, order: str = "batch_no", before: str = GENESIS) -> DataFrame:
    """batches with prev_hash and link_hash: each link seals the batch's id and hashes together with the link before.

    Seals are sorted by ranges and streamed in order by one task, as each needs the one before; records don't pass through here.
    """
    kept = [order, *SEALED]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev = before
        for batch in found:
            was, made = [], []
            for parts in zip(*(batch.column(c).to_pylist() for c in SEALED), strict=True):
                was.append(prev)
                prev = hashlib.sha256(UNIT.join([*(p for p in parts if p is not None), prev]).encode()).hexdigest()
                made.append(prev)
            yield pa.RecordBatch.from_arrays([batch.column(order), pa.array(was, pa.string()), pa.array(made, pa.string())], [order, "prev_hash", "link_hash"])

    rows = batches.select(F.col(order).cast("long").alias(order), *(F.col(c).cast("string").alias(c) for c in SEALED))
    files = ordered_files(rows.select(*kept), order)
    return batches.join(streamed(batches.sparkSession, files, run, f"`{order}` long, prev_hash string, link_hash string"), order)


def verify_chain(sealed: DataFrame, order: str = "batch_no", before: str = GENESIS) -> DataFrame:
    """links, first_broken (null: intact): every link is computed anew from its own row and its predecessor's stored link.

    Links are range partitioned; the first of a partition is compared with the last of the one before it.
    """
    placed = sealed.select(order, *SEALED, "prev_hash", "link_hash").repartitionByRange(order).withColumn("p", F.spark_partition_id()).checkpoint()
    last = placed.groupBy("p").agg(F.max_by("link_hash", order).alias("tail"))
    edges = last.select("p", F.lag("tail", 1, before).over(Window.orderBy("p")).alias("edge"))  # a row for each partition
    w = Window.partitionBy("p").orderBy(order)
    rows = placed.withColumn("prev", F.lag("link_hash").over(w)).join(F.broadcast(edges), "p")
    broken = (F.col("prev_hash") != F.coalesce("prev", "edge")) | (F.col("link_hash") != _seal(F.col("prev_hash"), *(F.col(c) for c in SEALED)))
    return rows.withColumn("broken", broken).agg(F.count("*").alias("links"), F.min(F.when(F.col("broken"), F.col(order))).alias("first_broken"))
