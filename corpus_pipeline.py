"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and works on all that its predecessor kept.

All but the last return the columns of documents. ``run`` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import common, contamination, mixing, neardup, sharding, toxicity


#: Columns that the operators take; the others have no say in a stage.
_TAKEN = ("doc_id", "text", "source")


def _plain_names(docs: DataFrame) -> list[str]:
    return [c if c in _TAKEN else f"c{i}" for i, c in enumerate(docs.columns)]


def _plain(docs: DataFrame) -> DataFrame:
    """The documents with all columns that the operators don't take renamed to c and a number, so that their names clash with nothing."""
    return docs.toDF(*_plain_names(docs))


def _named(plain: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of the documents under their own names."""
    return plain.select(*_plain_names(docs)).toDF(*docs.columns)


def _hash(plain: DataFrame, seed: int) -> Column:
    """A hash of all columns of a row; maps, which have no hash, count as JSON."""
    return F.xxhash64(F.lit(seed), *(F.to_json(F.struct(c.name)) if "map<" in c.dataType.simpleString() else F.col(c.name) for c in plain.schema))


def _keyed(docs: DataFrame, label: str) -> DataFrame:
    """The plain documents with row, a number of their own, and tie, a hash of all columns. They are written once, so that the numbers stay."""
    plain = _plain(docs)
    return common.written(plain.withColumns({"tie": _hash(plain, 0), "row": F.monotonically_increasing_id()}), label)


def _texts(keyed: DataFrame) -> DataFrame:
    """The texts as the operators take them, with the row's number for doc_id: ids may be null or repeated."""
    return keyed.select(F.col("row").alias("doc_id"), "text")


def _without(keyed: DataFrame, rows: DataFrame, docs: DataFrame, label: str) -> DataFrame:
    """The documents whose row is not among rows."""
    rows = common.written(rows, label)
    return _named(keyed.join(common.sized(rows, rows.count()), "row", "left_anti"), docs)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5. The machine learns from labelled documents that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.learn(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return _named(toxicity.with_scores(_plain(docs), machine).where("predicted = 0"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (runs of five words, similarity 0.8): that of smallest doc_id.

    Rows are compared by their texts alone. A null doc_id comes after all others; among equal ids the hash of all columns decides.
    """
    keyed = _keyed(docs, "near-rows")
    found = neardup.near_duplicates(_texts(keyed), k=5, percent=80).select(F.col("doc_id").alias("row"), "component_id")
    found = common.written(found, "near")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "tie", "row")
    first = keyed.select("row", "tie", "doc_id").join(found, "row").groupBy("component_id").agg(F.min(order).alias("first"))
    return _without(keyed, found.join(first.select("first.row"), "row", "left_anti").select("row"), docs, "copies")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (runs of five words, containment under 0.8)."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _keyed(docs, "leak-rows")
    found = contamination.contained_items(_texts(keyed), items).select(F.col("doc_id").alias("row")).distinct()
    return _without(keyed, found, docs, "leaks")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice; once if it has no word, as it then counts for nothing.

    Rows that are equal in every column are told apart by nothing, so what the mix takes of them together is dealt out among them
    evenly. Rows are compared by 128 hashed bits, so that reruns agree.
    """
    plain = _plain(docs)
    keyed = plain.withColumn("row", F.struct(_hash(plain, 0), _hash(plain, 1)))
    copies = mixing.mixed_copies(keyed.select(F.col("row").alias("doc_id"), "text", "source"))
    taken = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    found = common.written(copies.groupBy(F.col("doc_id").alias("row")).agg(F.sum(taken).alias("all"), F.count("*").alias("rows")), "taken")
    times = found.where("rows = 1 and all > 0").select("row", F.col("all").alias("times"))
    out = keyed.join(times, "row")
    again = found.where("rows > 1")
    if again.limit(1).count():
        placed = common.written(keyed.withColumn("at", F.monotonically_increasing_id()), "placed")
        equal, _ = common.ranked(placed.select("row", "at").join(common.sized(again, again.count()), "row"), "row", "at", name="place", label="equal")
        equal = common.written(equal, "equal")
        head = equal.groupBy("row").agg(F.min("place").alias("head"))
        nth = F.col("place") - F.col("head")
        dealt = equal.join(common.sized(head, again.count()), "row").select("at", (F.expr("all div rows") + (nth < F.col("all") % F.col("rows")).cast("long")).alias("times"))
        out = out.unionByName(placed.join(dealt.where("times > 0"), "at").drop("at"))
    return _named(out.select("*", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("copy")), docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard and slot of every row: 40 runs of the Hilbert order, in which equal texts follow each other."""
    dims = {"source": F.col("source"), "lang": F.col("lang"), "n_chars": F.col("n_chars")}
    return sharding.hilbert_shards(docs, dims, shards=40, law="rows")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]
#: Learning and iterated rounding are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
