"""What several operators share: written intermediate tables, size-checked joins, ranks, and text kernels on numpy.

The text kernels take a block of documents as one byte array, so that the cost for each document is a few array slices.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most so many rows of a few longs (about 40 MB).
BROADCAST_ROWS = 1_000_000
#: The same for sides of longer rows, and the rows of one key from which on they aren't dealt out by the key.
SIDE_ROWS, HOT_ROWS = 200_000, 50_000
#: Documents are handed to the kernels in blocks of about so many bytes; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where none is set and all runs on one machine."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="recordloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there and a lost executor loses nothing."""
    at = f"{shared_dir(df.sparkSession)}/recordloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def sized(side: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """The side with a broadcast hint if its counted rows allow; beyond that Spark joins by a shuffle."""
    return F.broadcast(side) if rows <= most else side


def matched(rows: DataFrame, side: DataFrame, on: list[str], total: int, most: int = SIDE_ROWS, how: str = "inner") -> DataFrame:
    """The rows whose key is in ``side``, with its columns but ``n``, the number of rows of the key; ``side`` has a key once.
    With ``how`` left the other rows stay, too.

    A side of ``most`` rows at most is broadcast. Of a larger one the keys of many rows are, which are ``most`` at most, and
    only rows of the other keys are shuffled, so no task gets more than a share of them.
    """
    if side.count() <= most:
        return rows.join(F.broadcast(side.drop("n")), on, how)
    hot = F.col("n") > max(HOT_ROWS, total // most)
    rest = rows.join(F.broadcast(side.where(hot).select(*on)), on, "left_anti").join(side.where(~hot).drop("n"), on, how)
    return rows.join(F.broadcast(side.where(hot).drop("n")), on).unionByName(rest)


def ranked(df: DataFrame, *order: Column | str, name: str = "rank", label: str = "ranked") -> tuple[DataFrame, int]:
    """Numbers all rows from 0 in the given order, and counts them, without a window over everything.

    Rows are range partitioned and sorted, written with their partition and place, and get the number of rows in earlier
    partitions added. Only a count for each partition passes through the driver.
    """
    at = f"__{name}_at"
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = written(placed, label)
    part = F.shiftright(at, 33)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    spark, total, offsets = df.sparkSession, 0, []
    for p, n in counts:
        offsets.append((p, total))
        total += n
    starts = spark.createDataFrame(offsets, "__part long, __before long")
    out = placed.join(F.broadcast(starts), part == F.col("__part"))
    return out.withColumn(name, F.col("__before") + F.col(at).bitwiseAND((1 << 33) - 1)).drop("__part", "__before", at), total


def running(df: DataFrame, amount: str, *order: Column | str, name: str, label: str) -> DataFrame:
    """df with ``name``, the sum of ``amount`` over all rows before in the order."""
    schema = df.schema
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            upto = before + np.cumsum(batch.column(amount).to_numpy(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - batch.column(amount).to_numpy())], [*batch.schema.names, "__before"])
            before = int(upto[-1]) if len(upto) else before

    summed = written(placed.mapInArrow(run, f"{fields}, __part int, __before long"), label)
    sums = sorted((r["__part"], r["s"]) for r in summed.groupBy("__part").agg(F.sum(amount).alias("s")).collect())  # a row for each partition
    starts = np.concatenate([[0], np.cumsum([s for _, s in sums])]).tolist()
    known = df.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(sums, starts, strict=False)], "__part int, __start long")
    return summed.join(F.broadcast(known), "__part").withColumn(name, F.col("__start") + F.col("__before")).drop("__part", "__start", "__before")


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def held(df: DataFrame, **made: Column) -> DataFrame:
    """Adds columns that are computed once for each row: a projection above may not copy their expressions into its own,
    which would evaluate them again for each use, or for each element inside a lambda."""
    one = F.explode(F.array(F.struct(*(c.alias(k) for k, c in made.items())))).alias("__held")
    return df.select("*", one).select(*df.columns, *(F.col(f"__held.{k}").alias(k) for k in made))


# ---- kernels -------------------------------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Every ASCII character that is no letter or digit parts words.
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[:128] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _PUNCT[_a:_b] = False

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def lowered(data: np.ndarray) -> np.ndarray:
    """A copy of the bytes with A-Z in lower case."""
    return _LOWER[data]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> _S33)
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    return x ^ (x >> _S33)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the rolling hash modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES + 4096)
        for k, base in enumerate((_R, _R_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """prefix[j] - prefix[i], times the inverse power i, depends on the bytes i to j only."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def blocks(batches: Iterator[pa.RecordBatch], keys: list[str], text: str = "text") -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Key columns, the bytes of all texts, and the texts' bounds, for runs of rows of about BLOCK_BYTES.

    A null text is empty.
    """
    for batch in batches:
        col = batch.column(text)
        col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
        col = col.fill_null(b"")
        n = len(col)
        if not n:
            continue
        bounds = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
        raw = col.buffers()[2]
        raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + BLOCK_BYTES, "right")) - 1)
            yield {k: batch.column(k).slice(a, b - a) for k in keys}, raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
            a = b


def words(data: np.ndarray, bounds: np.ndarray, parts: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every lower-cased word of a block, and where each document's words begin.

    Works through a long document in chunks that end between words.
    """
    hashes, starts_at = [], []
    cuts = set(bounds.tolist())
    step, lo, n = BLOCK_BYTES, 0, len(data)
    while lo < n:
        hi = min(n, lo + step)
        if hi < n and hi not in cuts:
            while hi < n and not parts[data[hi]]:
                more = np.flatnonzero(parts[data[hi : hi + 65536]])
                hi = hi + int(more[0]) if len(more) else min(n, hi + 65536)
        piece = _LOWER[data[lo:hi]]
        inside = ~parts[piece]
        first = np.empty(len(piece), bool)
        first[0] = inside[0]
        first[1:] = inside[1:] & ~inside[:-1]
        b = bounds[(bounds >= lo) & (bounds < hi)] - lo
        first[b] = inside[b]
        starts = np.flatnonzero(first)
        last = np.empty(len(piece), bool)
        last[-1] = inside[-1]
        last[:-1] = inside[:-1] & ~inside[1:]
        b = b[b > 0] - 1
        last[b] = inside[b]
        ends = np.flatnonzero(last) + 1
        prefix = prefix_hash(piece)
        hashes.append(mixed((prefix[ends] - prefix[starts]) * powers(len(piece) + 1)[1][starts]))
        starts_at.append(starts + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_at), bounds)


_STEP = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words; of the whole sequence where there are fewer."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < k:
        return mixed((hashes * _STEP[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    out = hashes[: n - k + 1] * _STEP[0]
    for j in range(1, k):
        out += hashes[j : n - k + 1 + j] * _STEP[j]
    return mixed(out)
