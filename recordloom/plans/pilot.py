"""The end-to-end workflow: redact, extract, reconcile, post, report, compare, map and pack, with a leak check before writing."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.decode import ASCII, value
from recordloom.functions.encode import encode_record
from recordloom.operators.custody import PostingSpec, ordered_digest, posting_manifest
from recordloom.operators.profiles import Redaction, extract_manifest, redact
from recordloom.operators.route import Control, Variant, VariantSpec, reconcile_banking
from recordloom.operators.views import Artifacts, diff_artifacts, field_map, pilot_packet, reconcile_report
from recordloom.plans.copybook import compile_layout


class LeakError(RuntimeError):
    """A cleartext value that should be redacted stands in an artifact; nothing was written."""


@dataclass(frozen=True)
class Pilot:
    """least: clear values of fewer characters aren't looked for in texts, where they stand by chance, but in their own field alone."""

    unit: str
    variants: VariantSpec
    control: Control
    posting: PostingSpec
    redaction: Redaction
    notes: str = ""
    least: int = 4


@dataclass(frozen=True)
class Evidence:
    """texts: short artifacts by name; rows: artifacts with a row for each record and field, which stay DataFrames."""

    texts: dict[str, str]
    rows: dict[str, DataFrame]


def _lines(df: DataFrame) -> DataFrame:
    return df.select("record_index", "field", F.to_json(F.struct(*df.columns)).alias("line"))


def _hidden(pilot: Pilot, encoding: str) -> dict[str, Column]:
    """The clear values of a detail's fields that aren't allowed to be seen."""
    layout = next(v for v in pilot.variants.variants if v.name == pilot.control.detail).layout
    return {f.name: value(f, encoding) for f in layout.elementary() if pilot.redaction.actions.get(f.name, pilot.redaction.unlisted) != "allow"}


def leaks(details: DataFrame, evidence: Evidence, pilot: Pilot, encoding: str = ASCII) -> list[str]:
    """Names of artifacts that hold a clear value of any record.

    Texts are looked through for every record's values, row artifacts for those of the row's own record. Values too short
    to be looked for in text are compared with what a row artifact gives for their own field, whole.
    """
    hidden = _hidden(pilot, encoding)
    if not hidden:
        return []
    clear = F.filter(F.array(*hidden.values()), lambda v: F.length(v) >= pilot.least)
    own = details.select("record_index", clear.alias("clear"), F.map_from_arrays(F.array(*map(F.lit, hidden)), F.array(*hidden.values())).alias("by_field"))
    texts = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).alias("text")) for k, v in sorted(evidence.texts.items())))
    bad = [own.select(F.explode("clear").alias("v")).distinct().select(F.explode(F.filter(texts, lambda t: F.contains(t["text"], F.col("v")))).alias("t")).select("t.name")]
    for name, rows in evidence.rows.items():
        shown = rows.select("record_index", "field", F.to_json(F.struct(*rows.columns)).alias("line"), (F.col("value") if "value" in rows.columns else F.lit(None).cast("string")).alias("shown"))
        inside, whole = F.exists("clear", lambda v: F.contains(F.col("line"), v)), (F.length("shown") > 0) & (F.col("shown") == F.try_element_at("by_field", F.col("field")))
        bad.append(shown.join(own, "record_index").where(inside | F.coalesce(whole, F.lit(False))).select(F.lit(name).alias("name")))
    found = bad[0]
    for b in bad[1:]:
        found = found.union(b)
    return sorted(r["name"] for r in found.distinct().collect())  # names of artifacts


def run_pilot(df: DataFrame, pilot: Pilot, encoding: str = ASCII) -> Evidence:
    """All artifacts of a unit, over all its records. Row artifacts are pinned in the packet by the digest of their lines."""
    detail = next(v for v in pilot.variants.variants if v.name == pilot.control.detail).layout
    details = df.where(F.coalesce(pilot.variants.route() == pilot.control.detail, F.lit(False)))
    short = lambda d: "\n".join(r["line"] for r in d.select(F.to_json(F.struct(*d.columns)).alias("line")).orderBy("line").collect()) + "\n"  # noqa: E731  a few rows
    rows = {"redaction": redact(details, detail, pilot.redaction, encoding), "fields": field_map(details, detail, pilot.redaction, encoding)}
    totals, findings = reconcile_banking(df, pilot.variants, pilot.control, encoding)
    report = reconcile_report(totals, findings, {"unit": pilot.unit})
    side = lambda c: Artifacts(totals=totals.select(F.lit("total").alias("kind"), F.col("measure").alias("name"), F.col(c).cast("string").alias("total"), F.lit(0).alias("count")))
    texts = {
        "extract": short(extract_manifest(df, detail, pilot.unit, {"unit": pilot.unit})), "casefile": report["json"], "report": report["markdown"], "sarif": report["sarif"],
        "posting": short(posting_manifest(details, detail, pilot.posting, encoding)), "diff": short(diff_artifacts(side("declared"), side("observed"))),
    }
    pins = {k: ordered_digest(_lines(r).withColumn("at", F.struct("record_index", "field")), "at", "line").first().asDict() for k, r in rows.items()}
    texts["packet"] = json.dumps(pilot_packet(texts | {k: json.dumps(p, sort_keys=True) for k, p in pins.items()}, pilot.notes) | {"rows": pins}, sort_keys=True)
    evidence = Evidence(texts, rows)
    if bad := leaks(details, evidence, pilot, encoding):
        raise LeakError(f"cleartext in {', '.join(bad)}")
    return evidence


def write_evidence(evidence: Evidence, folder: str) -> None:
    """Row artifacts as folders of JSON lines that Spark writes, and a file for each text."""
    for name, rows in evidence.rows.items():
        rows.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")
    fs, at = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    fs.create_dir(at, recursive=True)
    for name, text in evidence.texts.items():
        with fs.open_output_stream(f"{at.rstrip('/')}/{name}.txt") as f:
            f.write(text.encode())


# The fields and records of the declared sample unit; both fillers reach to the end of its 28 bytes.
DETAIL = compile_layout("""
       01 D.
           05 REC-TYPE PIC X.
           05 DR-CR-IND PIC X.
           05 ACCT-ID PIC X(8).
           05 AMOUNT PIC S9(7)V99 COMP-3.
           05 FILLER PIC X(13).
""")
TRAILER = compile_layout("""
       01 T.
           05 REC-TYPE PIC X.
           05 TRL-COUNT PIC 9(6).
           05 TRL-DEBIT PIC S9(9)V99 COMP-3.
           05 TRL-CREDIT PIC S9(9)V99 COMP-3.
           05 FILLER PIC X(9).
""")
SAMPLE = (("D", "ACCT0001", "100.00"), ("D", "ACCT0002", "50.00"), ("C", "ACCT0003", "30.00"))


def sample_unit(spark: SparkSession) -> DataFrame:
    """Two debits, a credit and the trailer that balances them."""
    money = lambda c: F.col(c).cast("decimal(11,2)")
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(SAMPLE)], "record_index long, ind string, acct string, amt string")
    details = rows.select("record_index", encode_record(DETAIL, {"REC-TYPE": F.lit("D"), "DR-CR-IND": F.col("ind"), "ACCT-ID": F.col("acct"), "AMOUNT": money("amt"), "FILLER": F.lit("")}).alias("record"))
    last = spark.createDataFrame([(len(SAMPLE), len(SAMPLE), "150.00", "30.00")], "record_index long, n long, dr string, cr string")
    unit = details.union(last.select("record_index", encode_record(TRAILER, {"REC-TYPE": F.lit("T"), "TRL-COUNT": F.col("n"), "TRL-DEBIT": money("dr"), "TRL-CREDIT": money("cr"), "FILLER": F.lit("")})))
    return unit.select("record_index", F.explode(F.array("record")).alias("record"))  # as if read: not made anew for each field


def sample_pilot(unit: str, notes: str = "") -> Pilot:
    spec = VariantSpec(0, 1, (Variant("D", b"D", DETAIL), Variant("T", b"T", TRAILER)))
    control = Control("D", "T", "AMOUNT", "DR-CR-IND", ("D",), ("C",), "TRL-COUNT", "TRL-DEBIT", "TRL-CREDIT", {"AMOUNT": "amount"})
    return Pilot(unit, spec, control, PostingSpec(unit, "SEQ-NO"), Redaction("pilot", {"ACCT-ID": "token"}, unlisted="allow"), notes)
