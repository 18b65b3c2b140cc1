"""Mixing sources to target weights by entropy balancing.

Each document gets a rate (expected copies): the rates closest in relative entropy to a common base rate whose words meet
every source's target, none above ``most``. The solution tilts the base exponentially, rate = min(most, base * exp(l * size
/ mean size)), with one multiplier l a source. Newton steps on the convex dual find all multipliers at once: each step is
one distributed aggregation over a histogram of (source, size), which loses nothing since a rate depends on these alone.
Rates are then rounded into whole copies so that each source's words stay within about its smallest document of the
target. Only Spark's own functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, sized, text_or_empty, written

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
STEPS = 60
TOLERANCE = 1e-6
#: Ranks within a (source, size) cell are counted in so many parts, so that a cell of copies is no single task.
PARTS = 256


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from (source, source_size): weights repeat along code point order, null last.

    The targets share ``share`` times all sizes by weight; one above ``most`` times its source's size stops there, and what it
    leaves is shared again by weight among the others until none is above.
    """
    numbered, _ = ranked(sizes, F.col("source").asc_nulls_last(), name="place", label="sources")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    at = written(numbered.select("source", "source_size", weight.alias("weight"), F.lit(False).alias("full")), "weights")
    total = (at.agg(F.sum("source_size").alias("s")).first()["s"] or 0) * share
    while True:
        full = F.col("full")
        used = at.agg(F.sum(F.when(full, most * F.col("source_size")).otherwise(0.0)).alias("used"), F.sum(F.when(~full, F.col("weight")).otherwise(0.0)).alias("w"), F.count_if(full).alias("n")).first()
        level = (total - used["used"]) / used["w"] if used["w"] else 0.0
        above = at.withColumn("full", full | (F.col("weight") * level > most * F.col("source_size")))
        if above.agg(F.count_if("full").alias("n")).first()["n"] == (used["n"] or 0):
            return at.select("source", "source_size", F.when(full, most * F.col("source_size")).otherwise(F.col("weight") * level).alias("target"))
        at = written(above, "weights")


def _rate(multiplier: Column, z: Column, base: float, most: float) -> Column:
    return F.least(F.lit(most), base * F.exp(F.least(multiplier * z, F.lit(700.0))))


def balanced(cells: DataFrame, targets: DataFrame, base: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, multiplier, mean, for cells (source, size, n) and targets; null multiplier where the target is at the limit.

    Newton steps from 0, kept inside a bracket of the root: the dual's gradient rises with the multiplier. Sizes of 0 don't
    bear on it.
    """
    means = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = targets.join(means, _same(targets["source"], means["source"])).drop(means["source"])
    at_limit = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    state = state.select("source", "mean", "target", at_limit.alias("limit"), F.when(at_limit, None).otherwise(F.lit(0.0)).alias("multiplier"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), at_limit.alias("done"))
    state = written(state, "multipliers")
    sources = state.count()
    for _ in range(STEPS):
        open_ = state.where("not done")
        s = sized(open_.select(F.col("source").alias("src"), "mean", "multiplier"), sources)
        z = F.col("size") / F.col("mean")
        rate = _rate(F.col("multiplier"), z, base, most)
        sums = cells.where("size > 0").join(s, _same(F.col("source"), F.col("src"))).groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("words"), F.sum(F.when(rate < most, F.col("n") * F.col("size") * z * rate).otherwise(0.0)).alias("slope")
        )
        j = state.join(sized(sums.withColumnRenamed("source", "src"), sources), _same(F.col("source"), F.col("src")), "left")
        gap = F.col("words") - F.col("target")
        low, high = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low")), F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high"))
        j = j.select("source", "mean", "target", "limit", "multiplier", low.alias("low"), high.alias("high"), (F.col("done") | (F.abs(gap) <= TOLERANCE * F.col("target"))).alias("done"), (F.col("multiplier") - gap / F.col("slope")).alias("newton"))
        inside = F.col("newton").isNotNull() & (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        beyond = F.when(F.col("high") == float("inf"), F.greatest(2 * F.col("low"), F.lit(1.0))).when(F.col("low") == float("-inf"), F.least(2 * F.col("high"), F.lit(-1.0))).otherwise((F.col("low") + F.col("high")) / 2)
        state = written(j.select("source", "mean", "target", "limit", F.when(F.col("done"), F.col("multiplier")).when(inside, F.col("newton")).otherwise(beyond).alias("multiplier"), "low", "high", "done"), "multipliers")
        if not state.where("not done").limit(1).count():
            break
    return state.select("source", "mean", "limit", "multiplier")


def _cell_copies(cells: DataFrame, multipliers: DataFrame, base: float, most: int) -> DataFrame:
    """source, size, copies (of all documents of the cell together), in whole numbers whose words meet what the rates ask.

    From the largest size down, a cell takes what the copies asked so far, rounded, exceed those of the cells before by. These
    running sums leave a source off by about its largest document at most. That is then made good from the largest size down by the
    cells that can still give or take, for each power of two the ones of its smallest and its largest size: a list of a few
    for each source, in which the words still owed are carried along and fall to about half the smallest size at the end.
    """
    m = multipliers.withColumnRenamed("source", "src")
    rate = F.when(F.col("limit"), F.lit(float(most))).otherwise(_rate(F.col("multiplier"), F.col("size") / F.col("mean"), base, float(most)))
    asked = F.col("n") * F.col("rate")
    rated = cells.where("size > 0").join(m, _same(F.col("source"), F.col("src"))).select("source", "size", "n", rate.alias("rate"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc())  # a row for each size of a source
    upto = F.floor(F.sum(asked).over(down.rowsBetween(Window.unboundedPreceding, 0)) + 0.5)
    given = rated.withColumn("upto", upto).withColumn("copies", F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0)))
    copies = F.least(F.greatest("copies", F.lit(0)), most * F.col("n")).cast("long")
    given = written(given.select("source", "size", "n", copies.alias("copies"), (F.col("size") * (asked - copies)).alias("owed")), "rounded")

    cell = F.struct("size", "n", "copies")
    can = {"more": F.col("copies") < most * F.col("n"), "less": F.col("copies") > 0}
    ends = [f(F.when(c, cell)).alias(f"{k}{i}") for k, c in can.items() for i, f in enumerate((F.min, F.max))]
    few = given.groupBy("source", F.length(F.bin("size")).alias("octave")).agg(F.array(*ends).alias("cells"), F.sum("owed").alias("owed"))
    lists = few.groupBy("source").agg(F.sort_array(F.array_distinct(F.filter(F.flatten(F.collect_list("cells")), lambda c: c.isNotNull())), asc=False).alias("cells"), F.round(F.sum("owed"), 3).alias("owed"))

    def step(a: Column, c: Column) -> Column:
        more = F.least(F.greatest(F.round(a["owed"] / c["size"]), -c["copies"].cast("double")), (most * c["n"] - c["copies"]).cast("double")).cast("long")
        return F.struct((a["owed"] - more * c["size"]).alias("owed"), F.concat(a["out"], F.array(F.struct(c["size"].alias("size"), more.alias("more")))).alias("out"))

    nothing = F.array().cast("array<struct<size:bigint,more:bigint>>")
    made = lists.select(F.col("source").alias("src"), F.explode(F.aggregate("cells", F.struct(F.col("owed").cast("double").alias("owed"), nothing.alias("out")), step)["out"]).alias("c"))
    made = made.select("src", F.col("c.size").alias("at"), "c.more").where("more <> 0")
    out = given.join(made, _same(F.col("source"), F.col("src")) & (F.col("size") == F.col("at")), "left")
    return out.select("source", "size", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"))


def mixed_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for every row of ``docs`` (doc_id, text, source; more is ignored).

    Size is the number of words, 0 for a null text; such documents get no copies. A null source is one source, after all
    others. Copies are whole, from 0 to ``most``; taken is copies times size. Rows with equal doc_id are documents of their
    own. Reruns agree: ties within a size are dealt by a hash of doc_id. An empty table gives no rows.
    """
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).cast("int")
    sized_docs = written(docs.select("doc_id", "source", size.alias("size"), part.alias("part"), F.xxhash64("doc_id", F.lit("turn")).alias("turn")), "sizes")
    counts = written(sized_docs.groupBy("source", "size", "part").agg(F.count("*").alias("n")), "counts")
    cells = written(counts.groupBy("source", "size").agg(F.sum("n").alias("n")), "cells")
    targets = written(source_targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, float(most)), "targets")
    sources = targets.count()
    copies = _cell_copies(cells, balanced(cells, targets, share, float(most)), share, most)

    # a cell's copies are dealt evenly: copies // n to each document, one more to the first copies % n of them
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    c = cells.join(copies.select(F.col("source").alias("s2"), F.col("size").alias("z2"), "copies"), _same(F.col("source"), F.col("s2")) & (F.col("size") == F.col("z2")), "left")
    plan = starts.join(c.select(F.col("source").alias("s3"), F.col("size").alias("z3"), F.col("n").alias("cell_n"), "copies"), _same(F.col("source"), F.col("s3")) & (F.col("size") == F.col("z3")))
    plan = written(plan.select(F.col("source").alias("s4"), F.col("size").alias("z4"), F.col("part").alias("p4"), "before", "cell_n", F.coalesce("copies", F.lit(0)).alias("cell_copies")), "plan")
    turn = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("turn", "doc_id"))
    dealt = sized_docs.withColumn("turn_no", turn).join(plan, _same(F.col("source"), F.col("s4")) & (F.col("size") == F.col("z4")) & (F.col("part") == F.col("p4")))
    rank = F.col("before") + F.col("turn_no") - 1
    own = F.floor(F.col("cell_copies") / F.col("cell_n")) + (rank < F.col("cell_copies") % F.col("cell_n")).cast("long")
    t = sized(targets.select(F.col("source").alias("s5"), "source_size", "target"), sources)
    return dealt.withColumn("copies", own).join(t, _same(F.col("source"), F.col("s5"))).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("copies").cast("int").alias("copies"))
