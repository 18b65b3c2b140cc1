"""Approximate nearest neighbours by an inverted multi-index.

Each half of a unit vector is quantised by a codebook of its own, so k centroids a half give k*k cells. A query goes through
pairs of centroids by the sum of their distances, which a heap yields in order, until the cells passed hold enough vectors;
those are ranked by their exact cosine. Equal vectors are one entry that carries its smallest ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The codebooks are fitted on at most so many distinct vectors, those of smallest hash.
MOST_SAMPLE = 20_000
#: Cells should hold about so many entries. Neighbouring cells are worked on together, as shelves of about SHELF entries; a
#: cell of more is worked on in blocks.
CELL, SHELF = 12, 2048
MOST_CENTROIDS = 256
#: Share of all entries that a query passes. The vectors of the test tables have no clusters to speak of (the fifth nearest
#: has a cosine of about 0.4), so recall follows this share; of 20,000 clustered vectors a hundredth does (tests/llm/test_ann.py).
SHARE = 0.6


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of both halves and the number of entries in each cell (first centroid * k + second)."""

    halves: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray

    @property
    def k(self) -> int:
        return len(self.halves[0])

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.halves[0].shape[1]
        return tuple(((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None]) for x, c in zip((unit[:, :cut], unit[:, cut:]), self.halves, strict=True))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(axis=1) * self.k + b.argmin(axis=1)

    def traverse(self, a: np.ndarray, b: np.ndarray, entries: int) -> list[int]:
        """Filled cells in ascending sum of the halves' distances, until they hold ``entries`` vectors.

        The heap holds the frontier of pairs (i, j) in each half's own order: a pair is pushed once both its predecessors are
        taken, so each comes out once and in order.
        """
        first, second, k = np.argsort(a, kind="stable"), np.argsort(b, kind="stable"), self.k
        heap, taken, out, held = [(a[first[0]] + b[second[0]], 0, 0)], np.zeros((k + 1, k + 1), bool), [], 0
        taken[-1, :] = taken[:, -1] = True
        while heap and held < entries:
            _, i, j = heapq.heappop(heap)
            taken[i, j] = True
            cell = int(first[i]) * k + int(second[j])
            if self.counts[cell]:
                out.append(cell)
                held += int(self.counts[cell])
            if i + 1 < k and taken[i + 1, j - 1]:
                heapq.heappush(heap, (a[first[i + 1]] + b[second[j]], i + 1, j))
            if j + 1 < k and taken[i - 1, j + 1]:
                heapq.heappush(heap, (a[first[i]] + b[second[j + 1]], i, j + 1))
        return out


def _centroids(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(1))
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(steps):
        near = ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        for i in np.flatnonzero(n):
            c[i] = x[near == i].mean(axis=0)
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to between 1/2 and 1: squares neither over- nor underflow.

    A cosine doesn't change by it, not even in its last digit.
    """
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(c: str) -> Column:
    """Not null, not empty, every component finite, and not all zero."""
    v = F.col(c)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _assigned(index: MultiIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = index.cells(_unit(_matrix(batch.column("vector"))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32))], [*batch.schema.names, "cell"])

    return run


def shelves(counts: np.ndarray, most: int = SHELF) -> tuple[np.ndarray, np.ndarray]:
    """The shelf of each cell, and the number of blocks of each shelf: runs of cells of ``most`` entries in all, or one cell of more."""
    shelf, blocks, held = np.zeros(len(counts), np.int32), [1], 0
    for c in np.flatnonzero(counts):
        if held and held + counts[c] > most:
            blocks.append(1)
            held = 0
        held += int(counts[c])
        shelf[c] = len(blocks) - 1
        blocks[-1] = -(-held // most)
    return shelf, np.array(blocks, np.int32)


def _visits(index: MultiIndex, entries: int, shelf: np.ndarray, blocks: np.ndarray):
    """A row for each shelf that a query passes: its number, its blocks, and the cells that the query passes there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = index.distances(_unit(_matrix(batch.column("vector"))))
            rows, at, cells = [], [], []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                found = np.sort(np.array(index.traverse(x, y, entries), np.int32))
                cut = np.flatnonzero(np.diff(shelf[found])) + 1
                parts = np.split(found, cut)
                rows += [i] * len(parts)
                at += [int(shelf[p[0]]) for p in parts]
                cells += parts
                if len(rows) > 5000 or i == len(a) - 1:
                    own = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(at, pa.int32()), pa.array(blocks[at]), pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "shelf", "many", "cells"])
                    rows, at, cells = [], [], []

    return run


#: A task holds so many found pairs before it hands them on.
_HELD = 400_000


def best_pairs(query: np.ndarray, key: np.ndarray, score: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's pairs that score no less than its keep-th best: all that tie with the last kept stay."""
    order = np.lexsort((-score, query))
    query, key, score = query[order], key[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
    size = np.diff(np.concatenate([first, [len(query)]]))
    least = np.repeat(score[first + np.minimum(keep, size) - 1], size)
    good = score >= least
    return query[good], key[good], score[good]


def _ranked_blocks(keep: int):
    """Rows come ordered by shelf, block and kind: a block's entries, then the queries that pass some of its cells.

    A task keeps the best of all its blocks for each query, and hands on what it holds when that grows large.
    """

    def batch_of(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in parts[0]], ["query", "key", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, cells, vectors, norms, place = None, [], [], [], None, None
        out: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            shelf, block, kind = (batch.column(c).to_numpy() for c in ("shelf", "block", "kind"))
            key, own = batch.column("key").to_numpy(), batch.column("cells")
            x = _scaled(_matrix(batch.column("vector")))
            change = np.flatnonzero((np.diff(shelf) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(shelf)], strict=True):
                if (here := (shelf[lo], block[lo])) != at:
                    at, keys, cells, vectors, norms = here, [], [], [], None
                if kind[lo] == 0:
                    keys.append(key[lo:hi])
                    cells.append(own.slice(lo, hi - lo).flatten().to_numpy())  # the entry's own cell
                    vectors.append(x[lo:hi])
                    continue
                if not keys:
                    continue
                if norms is None:
                    keys, vectors = [np.concatenate(keys)], [np.concatenate(vectors)]
                    cells, place = np.unique(np.concatenate(cells), return_inverse=True)
                    norms = np.linalg.norm(vectors[0], axis=1)
                for q in range(lo, hi, 512):
                    e = min(q + 512, hi)
                    passed = np.stack([np.isin(cells, own[j].values.to_numpy()) for j in range(q, e)])[:, place]
                    score = np.where(passed, x[q:e] @ vectors[0].T / (np.linalg.norm(x[q:e], axis=1)[:, None] * norms[None]), -np.inf)
                    n = min(keep, score.shape[1])
                    # all that tie with the last kept stay
                    least = -np.partition(-score, n - 1, axis=1)[:, n - 1]
                    r, c = np.nonzero((score >= least[:, None]) & passed)
                    out.append((key[q:e][r], keys[0][c], score[r, c]))
                    held += len(r)
                if held > _HELD:
                    out = [best_pairs(*(np.concatenate(c) for c in zip(*out, strict=True)), keep)]
                    if (held := len(out[0][0])) > _HELD // 2:
                        yield batch_of(out)
                        out, held = [], 0
        if held:
            yield batch_of([best_pairs(*(np.concatenate(c) for c in zip(*out, strict=True)), keep)])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, share: float = SHARE, entries: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k nearest of all other rows by cosine, ties to the smaller vec_id.

    ``vectors`` has vec_id and embedding; more columns are ignored. A query passes ``share`` of all entries, or ``entries`` if
    that is given, which keeps the work in proportion to the number of queries; k + 1 entries are passed at least. Vectors that
    are null, empty, all zero, hold a null or non-finite component, or have another length than most of the sample (a cosine
    needs equal lengths), take no part, nor do rows without an id. A repeated vec_id counts once a vector. Fewer than k others
    give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), is_query.alias("asks")).where("vec_id is not null").where(_usable("vector"))
    rows = written(rows.withColumn("key", F.xxhash64("vector")), "vectors")
    result = "query_id long, rank int, vec_id long, score double"
    total = rows.count()
    # the k + 1 smallest ids of each vector, in two steps, so that copies of one vector are not gathered at once
    parts = max(64, total // 50_000)
    few = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    some = rows.groupBy("key", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part")).agg(few(F.collect_list("vec_id")).alias("ids"))
    ids = some.groupBy("key").agg(few(F.flatten(F.collect_list("ids"))).alias("ids"))
    one = rows.groupBy("key").agg(F.first("vector").alias("vector"))
    distinct = written(one.join(ids, "key"), "distinct")
    n = distinct.count()
    sample = distinct.select("vector").orderBy(F.xxhash64("key", F.lit("fit"))).limit(MOST_SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], result)
    lengths = [len(r["vector"]) for r in sample]
    size = max(set(lengths), key=lambda v: (lengths.count(v), v)) if len(set(lengths)) > 1 else lengths[0]
    x = _unit(np.array([r["vector"] for r in sample if len(r["vector"]) == size]))
    distinct = distinct.where(F.size("vector") == size)
    centroids = int(min(MOST_CENTROIDS, len(x), max(1, round((n / CELL) ** 0.5))))
    cut = max(1, size // 2)
    index = MultiIndex((_centroids(x[:, :cut], centroids), _centroids(x[:, cut:], centroids) if size > cut else np.zeros((centroids, 0))), np.zeros(centroids**2, np.int64))
    placed = written(distinct.mapInArrow(_assigned(index), "key long, vector array<double>, ids array<long>, cell int"), "cells")
    for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # MOST_CENTROIDS squared at most
        index.counts[r["cell"]] = r["n"]

    asked = rows.where("asks").where(F.size("vector") == size).select("vec_id", "key").distinct()
    wanted = placed.select("key", "vector").join(asked.select("key").distinct(), "key", "left_semi")
    shelf, many = shelves(index.counts)
    passed = wanted.mapInArrow(_visits(index, max(k + 1, entries or int(np.ceil(share * n))), shelf, many), "key long, vector array<double>, shelf int, many int, cells array<int>")
    filled = np.flatnonzero(index.counts)
    where = F.broadcast(spark.createDataFrame(list(zip(filled.tolist(), shelf[filled].tolist(), many[shelf[filled]].tolist(), strict=True)), "cell int, shelf int, many int"))
    entry = placed.join(where, "cell").select("shelf", F.pmod(F.xxhash64("key", F.lit("block")), F.col("many")).cast("int").alias("block"), F.lit(0).alias("kind"), "key", "vector", F.array("cell").alias("cells"))
    query = passed.select("shelf", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("block"), F.lit(1).alias("kind"), "key", "vector", "cells")
    both = entry.union(query).repartition("shelf", "block").sortWithinPartitions("shelf", "block", "kind")
    found = both.mapInArrow(_ranked_blocks(k + 1), "query long, key long, score double")
    # ties beyond the (k + 1)th distinct vector go by smallest id
    found = found.join(placed.select("key", "ids"), "key")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("r") <= k + 1)
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("key").alias("query")).join(best, "query").select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
