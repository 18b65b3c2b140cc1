"""Declared rules as tables: many rules joined to the long form of records, where ``profiles`` makes an expression of each rule.

Only fields that a rule names are decoded. A table of rules is counted; a small one is broadcast, so that records aren't shuffled, and
a large one is joined by a shuffle, where Spark splits the partitions of frequent values.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.decode import ASCII, decode_long, raw_bytes, text_of
from recordloom.operators.findings import finding
from recordloom.operators.profiles import DateRule, date_status
from recordloom.plans.copybook import Layout

#: Rules, counted, up to which a table of them is broadcast.
RULES_BROADCAST = 500_000


def _small(rules: DataFrame) -> DataFrame:
    return F.broadcast(rules) if rules.limit(RULES_BROADCAST + 1).count() <= RULES_BROADCAST else rules


def _named(rules: DataFrame, layout: Layout) -> list[str]:
    """The layout's fields that rules name: at most as many as the layout has."""
    names = [f.name for f in layout.elementary()]
    return sorted(r["field"] for r in rules.where(F.col("field").isin(names)).select("field").distinct().collect())


def sentinels_by_table(df: DataFrame, layout: Layout, rules: DataFrame, encoding: str = ASCII) -> DataFrame:
    """record_index, field, meaning, value, raw_hex of each sentinel that occurs.

    rules: field, meaning, value, raw_hex; a rule goes by its value, or where that is null by its bytes, in either case of hex. Equal
    rules count once, rules without field or both of the others never match, and one place may have several meanings.
    """
    fields = _named(rules, layout)
    if not fields:
        return df.sparkSession.createDataFrame([], "record_index long, field string, meaning string, value string, raw_hex string")
    long = decode_long(df, replace(layout, fields=tuple(f for f in layout.elementary() if f.name in fields)), encoding)
    keys = F.explode(F.array(F.struct(F.lit("value").alias("by"), F.col("value").alias("key")), F.struct(F.lit("bytes").alias("by"), F.col("raw_hex").alias("key"))))
    rows = long.select("record_index", F.col("name").alias("field"), "value", "raw_hex", keys.alias("k")).select("record_index", "field", "value", "raw_hex", "k.*")
    by = F.when(F.col("value").isNotNull(), "value").otherwise("bytes")
    ruled = rules.where(F.col("field").isin(fields)).select("field", "meaning", by.alias("by"), F.coalesce("value", F.lower("raw_hex")).alias("key")).where("key is not null").distinct()
    return rows.join(_small(ruled), ["field", "by", "key"]).select("record_index", "field", "meaning", "value", "raw_hex")


def fieldless(rules: DataFrame, layout: Layout, rule_id: str = "SENTINEL-NO-FIELD") -> DataFrame:
    """A finding for each field that rules name and the layout lacks."""
    names = [f.name for f in layout.elementary()]
    gone = rules.where(~F.coalesce(F.col("field").isin(names), F.lit(False))).select("field").distinct()
    return gone.select(finding(rule_id, F.concat(F.lit("no field "), F.coalesce("field", F.lit("(null)")))).alias("f")).select("f.*")


def dates_by_table(df: DataFrame, layout: Layout, rules: DataFrame, sentinels: DataFrame, encoding: str = ASCII) -> DataFrame:
    """record_index, field, format, text, status, rule_ids for each rule and record, as ``date_validate`` has them.

    rules: field, format, require_sentinel; sentinels: field, text, the digits that are declared to be no date. A format that isn't
    known stops the query.
    """
    fields = _named(rules, layout)
    cells = [F.struct(F.lit(f.name).alias("field"), text_of(raw_bytes(f), encoding if f.usage == "DISPLAY" else ASCII).alias("text")) for f in layout.elementary() if f.name in fields]
    if not cells:
        return df.sparkSession.createDataFrame([], "record_index long, field string, format string, text string, status string, rule_ids array<string>")
    rows = df.select("record_index", F.explode(F.array(*cells)).alias("c")).select("record_index", "c.*")
    rows = rows.join(_small(rules.select("field", "format", F.coalesce("require_sentinel", F.lit(False)).alias("demand")).distinct()), "field")
    known = sentinels.where("field is not null and text is not null").select("field", "text", F.lit(True).alias("declared")).distinct()
    rows = rows.join(_small(known), ["field", "text"], "left")
    text = F.col("text")
    by_format = F.when(F.col("format") == "YYYYMMDD", date_status(text, DateRule("", "YYYYMMDD"))).when(F.col("format") == "YYDDD", date_status(text, DateRule("", "YYDDD")))
    status = F.when(F.col("declared"), "declared_sentinel").otherwise(F.coalesce(by_format, F.raise_error(F.concat(F.lit("unknown date format "), F.coalesce("format", F.lit("(null)")))).cast("string")))
    rows = rows.withColumn("status", status)
    bad = F.col("status") == "invalid_calendar"
    ids = F.array_compact(F.array(F.when(F.col("status") == "invalid_format", "DATE-INVALID-FORMAT"), F.when(bad, "DATE-INVALID-CALENDAR-DATE"), F.when(bad & F.col("demand"), "DATE-SENTINEL-UNDECLARED")))
    return rows.select("record_index", "field", "format", "text", "status", ids.alias("rule_ids"))
