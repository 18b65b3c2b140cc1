"""Ranked lexical search by Fagin's threshold algorithm over impact-sorted lists.

A pass over the texts tallies the query terms of each document into a forward index. Every task of a second pass takes a run of
documents as a segment: a list of documents for each term, sorted by impact, and the forward index itself. A query reads its
lists round-robin from the top; each document that it meets for the first time is scored whole by lookups in the forward index.
The impacts at the lists' present depth add up to a threshold that no unmet document exceeds, and the query stops when the
threshold falls strictly below its k-th score, so that equal scores can still be told apart by doc_id.

Statistics are those of the whole table, so segments' best documents merge into the best of all. Queries are taken in blocks of a
bounded number of terms; a segment has a bounded number of postings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Distinct terms, counted for each item, that one pass over the documents looks for; more items take more passes.
BLOCK_TERMS = 500_000
#: Postings of one segment.
SEGMENT = 2_000_000
#: The first round reads so many entries of each list, each further round twice as many as the one before.
ROUND = 8
#: Parts in which the tasks' best documents of an item meet before they meet in one.
MERGES = 64


def _terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return common.words(data, bounds, common._PUNCT)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, data, bounds in common.blocks(batches, ["item_id"]):
        hashes, at = _terms(data, bounds)
        found = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([keys["item_id"], pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([n for _, n in found], pa.list_(pa.int64())), pa.array([len(h) for h, _ in found], pa.int64())], ["item_id", "terms", "times", "size"])


def _tallies(vocabulary: np.ndarray):
    """doc_id, n, and the places in the sorted vocabulary of the terms that a document holds, each with its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary)
        for keys, data, bounds in common.blocks(batches, ["doc_id"]):
            hashes, at = _terms(data, bounds)
            n = np.diff(at)
            place = np.minimum(np.searchsorted(vocabulary, hashes), size - 1)
            hit = vocabulary[place] == hashes
            pairs, tf = np.unique(np.repeat(np.arange(len(n)), n)[hit] * size + place[hit], return_counts=True)
            offsets = pa.array(np.searchsorted(pairs, np.arange(len(n) + 1) * size).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pairs % size, tf)]
            yield pa.RecordBatch.from_arrays([keys["doc_id"], pa.array(n), *lists], ["doc_id", "n", "terms", "tf"])

    return run


class Segment:
    """Documents with a forward index (terms and impacts by document) and lists (documents and impacts by term, largest first).

    Documents are numbered by doc_id, null last, so the lower number comes first among equal scores.
    """

    def __init__(self, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, vocabulary: int):
        self.starts, self.terms, self.impacts = starts, terms, impacts
        docs = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        order = np.lexsort((docs, -impacts, terms))
        self.list_docs, self.list_impacts = docs[order], impacts[order]
        self.lists = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.times = np.zeros(vocabulary, np.int64)
        self.met = np.zeros(len(starts) - 1, bool)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores of some documents, looked up in the forward index; ``times`` holds the query."""
        lengths = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.starts[docs] - ends + lengths, lengths)
        sums = np.concatenate([[0], np.cumsum(self.impacts[at] * self.times[self.terms[at]])])
        return sums[ends] - sums[ends - lengths]

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the k best by the threshold algorithm, and the entries read. No score below ``floor`` is asked for."""
        self.times[terms] = times
        at, end = self.lists[terms].copy(), self.lists[terms + 1]
        docs, scores, step, read = np.zeros(0, np.int64), np.zeros(0, np.int64), ROUND, 0
        met = []
        while True:
            upto = np.minimum(at + step, end)
            found = np.unique(np.concatenate([self.list_docs[a:b] for a, b in zip(at, upto, strict=True)] or [docs]))
            read += int((upto - at).sum())
            new = found[~self.met[found]]
            if len(new):
                self.met[new] = True
                met.append(new)
                docs, scores = np.concatenate([docs, new]), np.concatenate([scores, self.scores(new)])
                order = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[order], scores[order]
            open_ = upto < end
            threshold = int((self.list_impacts[upto[open_] - 1] * times[open_]).sum())
            kth = max(floor, int(scores[k - 1]) if len(scores) == k else 0)
            if not open_.any() or threshold < kth:
                break
            at, step = upto, step * 2
        self.times[terms] = 0
        for m in met:
            self.met[m] = False
        some = scores > 0
        return docs[some], scores[some], read


def _merged(a: tuple, b: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of two runs of (score, doc_id, whether it is null)."""
    score, doc, null = (np.concatenate(x) for x in zip(a, b, strict=True))
    order = np.lexsort((doc, null, -score))[:k]
    return score[order], doc[order], null[order]


def _searched(items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, k: int, segment: int):
    """Each item's k best documents among those of a task."""
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def searched(rows: list[pa.RecordBatch], best: list[tuple]) -> None:
        table = pa.Table.from_batches(rows).combine_chunks()
        doc = table.column("doc_id").combine_chunks()
        null, ids = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
        order = np.lexsort((ids, null))
        table, ids, null = table.take(pa.array(order)), ids[order], null[order]
        terms, tf = table.column("terms").combine_chunks(), table.column("tf").combine_chunks()
        starts = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())]).astype(np.int64)
        place, count = terms.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)
        m = np.repeat(table.column("m").to_numpy(), np.diff(starts))
        made = Segment(starts, place, weights[place] * (1_000_000_000 * count // (1000 * count + 8 * m)), len(weights))
        for i, (_, wanted, times) in enumerate(items):
            floor = int(best[i][0][k - 1]) if len(best[i][0]) == k else 0
            docs, scores, _ = made.best(wanted, times, k, floor)
            best[i] = _merged(best[i], (scores, ids[docs], null[docs]), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, postings = [nothing] * len(items), [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                held.append(part)
                postings += len(part.column("terms").flatten())
                if postings >= segment:
                    searched(held, best)
                    held, postings = [], 0
        if held:
            searched(held, best)
        for (row, _, _), (score, doc, null) in zip(items, best, strict=True):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), row)), pa.array(doc, mask=null), pa.array(score)], ["row", "doc_id", "score"])

    return run


def _block(docs: DataFrame, rows: list, k: int, segment: int) -> DataFrame | None:
    """row, doc_id, score: the best documents of each item of a block, of every task."""
    vocabulary = np.unique(np.concatenate([np.array(r["terms"], np.int64).view(np.uint64) for r in rows]))
    index = common.written(docs.mapInArrow(_tallies(vocabulary), "doc_id long, n long, terms array<int>, tf array<int>").where("n > 0"), "tallies")
    whole = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not whole["docs"]:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # a row for each term of the block
        df[r["t"]] = r["n"]
    n = whole["docs"]
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    items = [(r["row"], np.searchsorted(vocabulary, np.array(r["terms"], np.int64).view(np.uint64)), np.array(r["times"], np.int64)) for r in rows]
    m = F.expr(f"25 + (cast(n AS decimal(18,0)) * {75 * n}BD) div {whole['terms']}BD").alias("m")
    return index.where(F.size("terms") > 0).select("doc_id", m, "terms", "tf").mapInArrow(_searched(items, weights, k, segment), "row long, doc_id long, score long")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS, segment: int = SEGMENT) -> DataFrame:
    """item_id, rank, doc_id, score: for every row of ``items`` (item_id, text) the k best of ``docs`` (doc_id, text).

    Terms are maximal runs of letters, digits and all beyond ASCII, with A-Z lower-cased; they are told by 64 hashed bits. Weights,
    lengths and scores are the whole numbers of the contract. Documents of score 0 aren't listed; equal scores come by ascending
    doc_id, null last. Repeated rows of either table are items or documents of their own. Null and empty texts have no terms
    and find nothing and aren't found. Empty tables give no rows. More columns of either table are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_terms, "item_id long, terms array<long>, times array<long>, size long")
    rows = common.written(rows.where("size > 0").withColumn("row", F.monotonically_increasing_id()), "items")
    rows = common.written(common.running(rows, "size", "row", name="before", label="item-sums").withColumn("block", F.floor(F.col("before") / block_terms)), "item-blocks")
    found = []
    for b in rows.select("block").distinct().orderBy("block").collect():  # a row for each block
        part = rows.where(F.col("block") == b["block"]).select("row", "terms", "times").collect()  # bounded by block_terms and one item
        if (best := _block(docs, part, k, segment)) is not None:
            found.append(best)
    best = spark.createDataFrame([], "row long, doc_id long, score long")
    for f in found:
        best = best.union(f)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["row", "part"], ["row"]):
        best = best.withColumn("part", F.spark_partition_id() % MERGES) if "part" in keys else best
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    names = rows.select("row", "item_id")
    return best.join(common.sized(names, names.count()), "row").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def oracle() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
        WITH d AS (SELECT doc_id, {terms} AS w FROM documents), whole AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
        p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({terms}) AS term FROM benchmark) GROUP BY ALL),
        t AS (SELECT term, count(*) AS df FROM p SEMI JOIN q USING (term) GROUP BY term),
        v AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM t, whole),
        s AS (
            SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
            FROM q JOIN p USING (term) JOIN v USING (term), whole GROUP BY ALL
        ), r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
    """
