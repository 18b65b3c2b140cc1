"""Near-duplicate documents by min-max hashing of word shingles, confirmed on the full sets.

Each hash permutation gives both its minimum and its maximum over a document's shingles, so a signature of 2p entries costs
p evaluations. Runs of entries make band keys. Equal shingle sets become one class first. Within the buckets, classes are
compared with hubs before anything else, and only pairs whose members are still in different components, and that nothing
known rules out, are compared after that, so that a bucket of copies doesn't yield all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A pair of similarity 0.8 shares no band with probability (1 - 0.8**6)**48, 5e-7.
BANDS, ROWS = 48, 6
#: A set's parity map has 64 bits for each word; an element flips one bit, so maps differ in no more bits than sets in elements.
PARITY_WORDS = 16


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(8))
    return rng.integers(1, 2**64, (count, 1), dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, (count, 1), dtype=np.uint64)


def minmax(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum and maximum of a*v+b modulo 2**64 for each permutation, side by side."""
    low = np.full(len(a), np.uint64(2**64 - 1))
    high = np.zeros(len(a), np.uint64)
    for i in range(0, len(values), 2048):
        h = values[i : i + 2048] * a
        h += b
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def _sets(k: int, banded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(BANDS * ROWS // 2)
        weights = np.random.Generator(np.random.PCG64(88)).integers(1, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
        salt = np.random.Generator(np.random.PCG64(888)).integers(0, 2**64, BANDS, dtype=np.uint64)
        for keys, data, bounds in common.blocks(batches, ["doc_id"]):
            hashes, at = common.words(data, bounds)
            size, digest, lists, parity = [], [], [], []
            for i in range(len(bounds) - 1):
                s = np.unique(common.shingles(hashes[at[i] : at[i + 1]], k))
                size.append(len(s))
                digest.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
                if banded and len(s):
                    s = common.mixed((minmax(s, a, b).reshape(BANDS, ROWS) * weights).sum(axis=1, dtype=np.uint64) + salt)
                elif not banded:
                    odd = np.bincount((s & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
                    parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                lists.append(s.view(np.int64))
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
            cols = [keys["doc_id"].cast(pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.int64()), values]
            if not banded:
                cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(parity) + 1, dtype=np.int32) * PARITY_WORDS), pa.array(np.concatenate(parity))))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "node", "items", "parity"][: len(cols)])

    return run


_SCHEMA = "doc_id long, n_shingles long, node long, items array<long>"


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that it reaches.

    Alternates large-star and small-star steps; each is a minimum for each node and a join, and hubs of any degree are
    partially aggregated. Every step is checkpointed.
    """

    def stars(pairs: DataFrame, near: DataFrame) -> DataFrame:
        low = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return pairs.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")

    at = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    while True:
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stars(both.where("v > u"), both).distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        loops = large.union(large.select("u", F.col("u").alias("v")))
        at = stars(loops, large).distinct().checkpoint()
        now = at.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).union(at.select(F.col("v"), F.col("v")).distinct())


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(two, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def _lonely(sets: DataFrame) -> DataFrame:
    """node, alone: how many of a node's shingles no other node has. They cannot be shared, so they bound any similarity."""
    seen = sets.select("node", F.explode("items").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("node"))
    return seen.where("c = 1").groupBy("node").agg(F.count("*").alias("alone"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text; more columns are ignored).

    A document's set holds its distinct runs of k lower-cased words; with fewer words, the whole sequence as one. Two
    documents are linked when their sets overlap in at least ``percent`` hundredths of their union. component_id is the
    smallest doc_id that is reachable. Null and empty texts have an empty set and are linked with nothing. Rows with equal
    texts are linked; a repeated doc_id gives a row each time. A row without doc_id is returned with null component_id and is
    kept. An empty table gives no rows.

    In each bucket the hub is the member with the fewest shingles of its own: where copies vary one text, it is the nearest to
    what they have in common. Every member meets a hub; then hubs in other components; then whatever bucket members are still
    in different components meet. Pairs that sizes, own shingles or parity maps rule out are never made, which loses no link.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = common.written(docs.mapInArrow(_sets(k, True), _SCHEMA), "signatures")
    nodes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("items").alias("items"))
    banded = nodes.select("node", "doc_id", "n", F.explode("items").alias("key"))
    shared = common.written(banded.join(banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "key"), "buckets")

    wanted = common.written(shared.select("doc_id").distinct(), "wanted")
    chosen = docs.join(common.sized(wanted, wanted.count()), "doc_id", "left_semi")
    sets = common.written(chosen.mapInArrow(_sets(k, False), _SCHEMA + ", parity array<long>").select("node", "items", "parity").dropDuplicates(["node"]), "sets")
    shared = shared.join(_lonely(sets), "node", "left").select("key", "node", "n", "members", F.coalesce("alone", F.lit(0)).alias("alone"))
    hubs = shared.groupBy("key").agg(F.min(F.struct("alone", "node", "n")).alias("hub"))
    shared = common.written(shared.join(hubs, "key"), "hubs")

    def fits(n1: str, alone1: str, n2: str, alone2: str) -> Column:
        a, b, x, y = F.col(n1), F.col(n2), F.col(alone1), F.col(alone2)
        return (100 * (a - x) >= percent * (b + x)) & (100 * (b - y) >= percent * (a + y))

    a, b = F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")
    near = shared.where("node <> hub.node").where(fits("n", "alone", "hub.n", "hub.alone"))
    nearest = near.groupBy("node").agg(F.min(F.struct("hub.alone", "hub.node")).alias("hub")).select("node", F.col("hub.node").alias("hub"))
    links = common.written(_confirmed(nearest.select(a, b).distinct(), sets, percent), "links1")
    roots = components(links)

    def labelled(rows: DataFrame, node: str, name: str) -> DataFrame:
        return rows.join(roots.select(F.col("node").alias(node), F.col("root").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

    rest = near.select("node", F.col("hub.node").alias("hub")).distinct()
    rest = labelled(labelled(rest, "node", "r1"), "hub", "r2").where("r1 <> r2").select(a, b).distinct()
    links = common.written(links.union(_confirmed(rest, sets, percent)), "links2")
    roots = components(links)

    # buckets that still hold several components: what is outside a bucket's largest component meets the other components
    could = F.col("members") > 2
    possible = 100 * (F.col("n") - F.col("alone")) >= percent * (F.col("n") * percent / 100 + F.col("alone"))
    mine = labelled(shared.where(could & possible).select("key", "node", "n", "alone", F.col("hub.node").alias("hub")), "node", "root")
    parts = mine.groupBy("key", "root").agg(F.count("*").alias("c"))
    split = parts.groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("k")).where("k > 1").select("key", F.col("top.root").alias("top"))
    mine = mine.join(split, "key").where("node <> hub").join(sets.select("node", "parity"), "node")
    mine = common.written(mine.select("*", *(F.get("parity", F.lit(i)).alias(f"w{i}") for i in range(PARITY_WORDS))).drop("parity"), "split")
    some = mine.where("root <> top").select("key", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("alone").alias("xa"), "top", *(F.col(f"w{i}").alias(f"v{i}") for i in range(PARITY_WORDS)))
    other = mine.select("key", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("alone").alias("xb"), *(f"w{i}" for i in range(PARITY_WORDS)))
    apart = sum((F.bit_count(F.col(f"w{i}").bitwiseXOR(F.col(f"v{i}"))) for i in range(1, PARITY_WORDS)), F.bit_count(F.col("w0").bitwiseXOR(F.col("v0"))))
    similar = (100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))
    cross = some.join(other, (some["key"] == other["key"]) & F.expr("ra <> rb and (rb = top or a < b)") & fits("na", "xa", "nb", "xb") & similar)
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = common.written(links.union(_confirmed(cross, sets, percent)).distinct(), "links3")
    roots = common.written(components(links), "roots")

    rows = signed.drop("items").join(roots, "node", "left").withColumn("root", F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")))
    first = rows.where("root is not null and doc_id is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = rows.join(first, "root", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
