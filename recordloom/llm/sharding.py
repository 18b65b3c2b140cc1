"""Shards along a Hilbert curve over quantised metadata, so that each shard is a narrow box in every dimension.

Documents are sorted by the curve's index of their quantised dimensions and the order is cut into runs. Files made this way
can be skipped by a filter on any of the dimensions, not only by one on the first sort column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import matched, ranked, text_or_empty, written

BITS = 5
#: The curve is a table of all cells that is broadcast; all dimensions together have at most so many bits, so it has a million rows at most.
MOST_BITS = 20
#: Running sums over all rows are taken within so many equal runs, and over their sums.
CHUNKS = 1024
#: Bytes that a record costs besides its text.
OVERHEAD = 16


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of each row of small whole numbers below 2**bits, by the transposed-bits method."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_table(spark: SparkSession, dims: int, bits: int) -> DataFrame:
    """cell, own: the index along the curve of each cell; a cell is the dimensions' numbers, the first in the highest bits."""
    cell = np.arange(1 << (dims * bits), dtype=np.int64)
    points = np.stack([(cell >> (bits * (dims - 1 - i))) & ((1 << bits) - 1) for i in range(dims)], axis=1)
    return spark.createDataFrame(pa.table({"cell": cell, "own": hilbert_index(points, bits)}))


def _boundaries(df: DataFrame, c: str, bits: int) -> list:
    """At most 2**bits - 1 ascending values of a column that cut its rows into nearly equal parts; none for nulls."""
    values = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    placed, distinct = ranked(values, c, name="place", label="values")
    # the value at which the running count crosses each multiple of total / 2**bits
    chunk = F.floor(F.col("place") * CHUNKS / F.lit(max(distinct, 1))).alias("chunk")
    placed = written(placed.select("*", chunk), "values")
    sums = placed.groupBy("chunk").agg(F.sum("n").alias("s")).orderBy("chunk")
    before = F.coalesce(F.sum("s").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("before", before).drop("s")
    run = F.sum("n").over(Window.partitionBy("chunk").orderBy("place"))
    total = values.agg(F.sum("n").alias("n")).first()["n"] or 0
    ends = placed.withColumn("run", run).join(F.broadcast(starts), "chunk").withColumn("end", F.col("run") + F.col("before"))
    cell = lambda e: F.floor(e * (1 << bits) / F.lit(max(total, 1)))
    cut = ends.where(cell(F.col("end")) > cell(F.col("end") - F.col("n"))).where(F.col("end") < total)
    return sorted(r[c] for r in cut.select(c).distinct().collect())


def _cell(c: str, bounds: list) -> Column:
    """How many boundaries lie below the value: 0 for null, and order is kept."""
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b < F.col(c))), F.lit(0))


def hilbert_shards(docs: DataFrame, dims: dict[str, Column], shards: int = 40, law: str = "rows", bits: int = BITS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with size, text_crc32, law, shard, slot; shards are runs of the Hilbert order.

    ``dims`` names the dimensions. Each is quantised at its quantiles over all rows, keeping order; nulls come first. Rows of
    equal texts take the place on the curve of the first of them, and ties along the curve go by the text's hash, checksum and
    size and by doc_id: equal texts follow each other, and only a cut between two shards can part them. Under the law ``rows``
    the shards' row counts are at most one apart; under ``bytes`` a row's shard follows from the bytes before it. slot counts
    from 0 without gaps. Repeated rows get slots of their own; a null text is empty, without bytes and of checksum 0; an empty
    table gives no rows. With many dimensions each has fewer bits, MOST_BITS in all.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law}")
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("same"), *(c.alias(f"dim_{k}") for k, c in dims.items()))
    rows = written(rows, "dims")
    bits = max(1, min(bits, MOST_BITS // len(dims)))
    cell = F.lit(0).cast("long")
    for k in dims:
        cell = cell * (1 << bits) + _cell(f"dim_{k}", _boundaries(rows, f"dim_{k}", bits)).cast("long")
    group = ["same", "text_crc32", "size"]
    curve = F.broadcast(curve_table(docs.sparkSession, len(dims), bits))
    rows = written(rows.select("doc_id", *group, cell.alias("cell")).join(curve, "cell").drop("cell"), "own")
    apart = rows.groupBy(*group).agg(F.count("*").alias("n"), F.min("own").alias("least"), F.max("own").alias("most")).where("least < most")
    apart = written(apart.drop("most"), "apart")
    rows = matched(rows, apart, group, rows.count(), how="left").withColumn("curve", F.coalesce("least", "own")).drop("least", "own")
    # rows that are equal in all of these are one as good as the other; their number parts them where they are many
    placed, total = ranked(rows, "curve", *group, "doc_id", F.monotonically_increasing_id(), name="place", label="curve")
    if law == "rows":
        shard = F.floor(F.col("place") * shards / F.lit(max(total, 1)))
        first = F.ceil(shard * F.lit(max(total, 1)) / F.lit(shards))
        return placed.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), shard.cast("int").alias("shard"), (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
    chunk = F.floor(F.col("place") * CHUNKS / F.lit(max(total, 1)))
    placed = written(placed.withColumn("chunk", chunk), "placed")
    sums = placed.groupBy("chunk").agg(F.sum("size").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("before", before).drop("s")
    all_bytes = placed.agg(F.sum("size").alias("s")).first()["s"] or 1
    run = F.sum("size").over(Window.partitionBy("chunk").orderBy("place")) - F.col("size")
    cut = placed.withColumn("run", run).join(F.broadcast(starts), "chunk").withColumn("shard", F.floor((F.col("run") + F.col("before") + F.col("size") / 2) * shards / F.lit(all_bytes)).cast("int"))
    cut = written(cut, "cut")
    firsts = cut.groupBy("shard").agg(F.min("place").alias("first"))
    return cut.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
