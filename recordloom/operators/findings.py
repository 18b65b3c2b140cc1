"""Findings: rule, level, message and, where there is one, the record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FINDING = "rule_id string, level string, message string, record_index long"


def finding(rule: str, message: Column, record: str | None = None, level: str = "warning") -> Column:
    at = F.col(record).cast("long") if record else F.lit(None).cast("long")
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(level).alias("level"), message.cast("string").alias("message"), at.alias("record_index"))
