"""Benchmark items inside documents: size-partitioned MinHash containment search, verified by exact shingle containment.

An item's sketch is the shingle of smallest hash under each of several permutations. If a share c of the item's shingles
stands in a document, each sketch entry is found there with probability c, however long the document is. Sketches and
documents are partitioned by powers of two of their set sizes: a sketch is looked for only in partitions whose documents are
large enough to hold the item. Found candidates are verified on all shingles of the item. Only Spark's own functions run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, sized, written

#: At containment 0.8 an item is missed with probability 0.2**16, under 1e-11.
SKETCH = 16
#: Words are lower-cased runs of ASCII letters, digits and anything beyond ASCII: marks and spaces part them.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, PARTS), lambda w: w != "")


def _runs(m: int, tag: Column | None = None) -> Column:
    """The hashes of all runs of m words of w, none where there are fewer."""
    more = [] if tag is None else [tag]
    return F.transform(F.slice("w", 1, F.greatest(F.size("w") - m + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get("w", i + j) for j in range(1, m)), *more))


def _shingled(rows: DataFrame, key: str, k: int, short: list[int]) -> DataFrame:
    """key, and the hashes of the runs of k words, repeats included, and of the shorter runs asked for; no row where there is no word."""
    rows = held(rows.select(key, "text"), w=_words(F.col("text"))).where(F.size("w") > 0)
    runs = F.concat(_runs(k), *(_runs(m, F.lit(f"short {m}")) for m in short))
    return held(rows.select(key, "w"), s=runs).select(key, "s").where(F.size("s") > 0)


def _item_sets(items: DataFrame, k: int) -> DataFrame:
    """item_id, h, length: an item's distinct runs of k words; with fewer words the whole sequence, marked with its length."""
    rows = held(items.select("item_id", "text"), w=_words(F.col("text"))).where(F.size("w") > 0)
    runs = _runs(k)
    for m in range(1, k):
        runs = F.when(F.size("w") == m, _runs(m, F.lit(f"short {m}"))).otherwise(runs)
    return held(rows.select("item_id", "w"), s=runs).select("item_id", F.least(F.size("w"), F.lit(k)).alias("length"), F.explode("s").alias("h")).distinct()


def _class(size: Column) -> Column:
    return F.floor(F.log2(size.cast("double"))).cast("int")


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, sketch: int = SKETCH) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: documents that hold at least ``percent`` hundredths of an item's shingles.

    ``docs`` has doc_id and text, ``items`` has item_id and text; more columns are ignored. Sets are distinct runs of k words.
    An item of fewer words is one run of its own length, looked for among the documents' runs of that length. Texts that are
    null or hold no word, and rows without an id, match nothing. Repeated rows and equal items count once for each id. An id with
    several texts has the runs of all. Empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    sets = written(_item_sets(items, k), "items")
    short = sorted(r["length"] for r in sets.where(F.col("length") < k).select("length").distinct().collect())  # k - 1 numbers at most
    sets = sets.select("item_id", "h")
    size = sets.groupBy("item_id").agg(F.count("*").cast("int").alias("n_item"))

    # sketches: the smallest of each permutation; a permutation is the hash seeded by its number
    seeds = sets.select("item_id", "h", F.explode(F.sequence(F.lit(1), F.lit(sketch))).alias("p"))
    small = seeds.groupBy("item_id", "p").agg(F.min_by("h", F.xxhash64("h", "p")).alias("h")).select("item_id", "h").distinct().join(size, "item_id")
    least = F.ceil(F.col("n_item") * percent / F.lit(100.0))
    small = written(small.groupBy(F.col("h").alias("sh")).agg(F.min(_class(least)).alias("from_part")), "sketches")
    entries = small.count()

    shingled = _shingled(docs, "doc_id", k, short)
    run = shingled.select("doc_id", F.greatest(_class(F.size("s")), F.lit(0)).alias("part"), F.explode("s").alias("h"))
    found = run.join(sized(small, entries), (F.col("h") == F.col("sh")) & (F.col("part") >= F.col("from_part")), "left_semi").select("doc_id").distinct()
    found = written(found, "candidates")

    # exact: all shingles of the candidate documents against all shingles of the items
    near = docs.join(sized(found, found.count()), "doc_id", "left_semi")
    run = _shingled(near, "doc_id", k, short).select("doc_id", F.explode(F.array_distinct("s")).alias("h"))
    shared = run.join(sized(sets, sets.count()), "h").select("doc_id", "item_id", "h").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    out = shared.join(size, "item_id").where(100 * F.col("n_shared") >= percent * F.col("n_item"))
    return out.select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def miss_probability(percent: int = 80, sketch: int = SKETCH) -> float:
    """Of an item that is contained by just ``percent``: no sketch entry stands in the document."""
    return math.pow(1 - percent / 100, sketch)


def oracle(k: int = 5, percent: int = 80) -> str:
    """Exact containment of every pair in DuckDB."""
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PARTS}'), lambda x: x <> '')"
    rows = lambda t, key: f"SELECT {key}, {words} AS w FROM {t} WHERE {key} IS NOT NULL"
    runs = "unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i+m-1], ' ') || '|' || m)) AS h"
    return f"""
WITH dw AS ({rows("documents", "doc_id")}), bw AS (SELECT *, least(len(w), {k}) AS m FROM ({rows("benchmark", "item_id")}) WHERE len(w) > 0),
lengths AS (SELECT {k} AS m UNION SELECT m FROM bw), ds AS (SELECT DISTINCT doc_id, {runs} FROM dw, lengths WHERE len(w) >= m), bs AS (SELECT DISTINCT item_id, {runs} FROM bw), n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (h) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= {percent} * n_item"""
