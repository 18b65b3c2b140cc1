"""Evidence views: structural diff, reports, field maps, replay of fixtures, and the packet that pins its parts."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.decode import ASCII
from recordloom.operators.profiles import Redaction, redact
from recordloom.operators.recon import courts_of
from recordloom.plans.copybook import Layout

NOT_ORACLE = "equal to the declared target, whose status is {}: this doesn't make it right"
#: What a target may be compared in, and what it may be declared as; only an admitted oracle is trusted.
DIMENSIONS = ("field_values", "finding_ids", "control_totals", "audit_hashes")
ORACLE = "admitted_oracle"
STATUSES = ("not_oracle", "declared_baseline", "customer_supplied_reference", "system_of_record_export_unvalidated", ORACLE)


def diff_fields(left: DataFrame, right: DataFrame, key: str = "record_index", name: str = "name", value: str = "value") -> DataFrame:
    """key, name, rule_id, left, right where two long tables differ: missing, extra or mismatched fields.

    A full outer join on record and field. Of several rows with one key and name, the largest value stands for them.
    """
    a = left.groupBy(key, name).agg(F.max(value).alias("left"), F.lit(True).alias("in_left"))
    b = right.groupBy(key, name).agg(F.max(value).alias("right"), F.lit(True).alias("in_right"))
    j = a.join(b, [key, name], "full_outer")
    rule = F.when(F.col("in_right").isNull(), "DIFF-MISSING-FIELD").when(F.col("in_left").isNull(), "DIFF-EXTRA-FIELD").when(~F.col("left").eqNullSafe(F.col("right")), "DIFF-FIELD-MISMATCH")
    return j.withColumn("rule_id", rule).where("rule_id is not null").select(key, name, "rule_id", "left", "right")


#: Keys of a leaf of a digest tree, and leaves of a node above.
LEAF_KEYS, FAN_OUT = 4096, 1024


def digest_tree(long: DataFrame, key: str = "record_index", name: str = "name", value: str = "value", width: int = LEAF_KEYS) -> DataFrame:
    """leaf, rows, x, y, total: a digest of all fields of each range of ``width`` keys, whatever the order of rows.

    Written next to an artifact it can be compared again without reading the artifact. Digests are two 64-bit exclusive ors
    of hashes under different seeds, with a count and an exact sum, so that repeated rows don't cancel. Null differs from empty.
    """
    cells = [F.col(key), F.col(name), F.col(value), F.col(value).isNull(), F.col(name).isNull()]
    hashed = long.select(F.floor(F.col(key) / width).cast("long").alias("leaf"), F.xxhash64(F.lit(1), *cells).alias("h"), F.xxhash64(F.lit(2), *cells).alias("g"))
    return hashed.groupBy("leaf").agg(F.count("*").alias("rows"), F.bit_xor("h").alias("x"), F.bit_xor("g").alias("y"), F.sum(F.col("g").cast("decimal(38,0)")).alias("total"))


def differing_leaves(left: DataFrame, right: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """leaf of each range whose digests in two trees differ, or that one tree alone has.

    Nodes of ``fan_out`` leaves are compared first; only leaves of nodes that differ are joined.
    """

    def nodes(tree: DataFrame) -> DataFrame:
        return tree.groupBy(F.floor(F.col("leaf") / fan_out).alias("node")).agg(F.sum("rows").alias("rows"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("total").cast("decimal(38,0)").alias("total"))

    def apart(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
        digest = F.struct("rows", "x", "y", "total")
        j = a.select(on, digest.alias("a")).join(b.select(on, digest.alias("b")), on, "full_outer")
        return j.where(~F.col("a").eqNullSafe(F.col("b"))).select(on)

    open_ = apart(nodes(left), nodes(right), "node")
    inside = lambda tree: tree.withColumn("node", F.floor(F.col("leaf") / fan_out)).join(open_, "node", "left_semi")
    return apart(inside(left), inside(right), "leaf")


def diff_ranges(left: DataFrame, right: DataFrame, key: str = "record_index", name: str = "name", value: str = "value", width: int = LEAF_KEYS, trees: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> DataFrame:
    """The rows of ``diff_fields``, found by digests of key ranges first.

    Only the rows of ranges that differ are joined, so what is shuffled falls with what is equal. trees are digest trees of the
    sides of the same ``width``, where they are known; keys are whole numbers, and rows without one are always compared.
    """
    made = [t if t is not None else digest_tree(d, key, name, value, width) for t, d in zip(trees, (left, right), strict=True)]
    leaves = differing_leaves(*made).checkpoint()
    return diff_fields(*(in_leaves(d, leaves, key, width) for d in (left, right)), key, name, value)


def in_leaves(long: DataFrame, leaves: DataFrame, key: str, width: int) -> DataFrame:
    """The rows whose key is in one of the leaves, or null."""
    leaf = F.floor(F.col(key) / width).cast("long")
    few = F.broadcast(leaves) if leaves.count() <= LEAVES_BROADCAST else leaves
    return long.withColumn("__leaf", leaf).join(few.withColumnRenamed("leaf", "__leaf"), "__leaf", "left_semi").drop("__leaf").union(long.where(F.col(key).isNull()))


#: Differing leaves, counted, up to which their numbers are broadcast.
LEAVES_BROADCAST = 1_000_000


def diff_sets(left: DataFrame, right: DataFrame, column: str, rule: str = "DIFF-FINDING-SET-MISMATCH") -> DataFrame:
    """rule_id, value, side: distinct values that one side alone has."""
    a, b = left.select(F.col(column).alias("value")).distinct(), right.select(F.col(column).alias("value")).distinct()
    return a.join(b, "value", "left_anti").withColumn("side", F.lit("left")).union(b.join(a, "value", "left_anti").withColumn("side", F.lit("right"))).select(F.lit(rule).alias("rule_id"), "value", "side")


def diff_totals(left: DataFrame, right: DataFrame) -> DataFrame:
    """kind, name, rule_id, left, right of control totals that differ."""
    show = F.concat_ws("/", F.coalesce("total", F.lit("-")), F.col("count").cast("string"))
    a, b = left.select("kind", "name", show.alias("left")), right.select("kind", "name", show.alias("right"))
    return a.join(b, ["kind", "name"], "full_outer").where(~F.col("left").eqNullSafe(F.col("right"))).select("kind", "name", F.lit("DIFF-CONTROL-TOTAL-MISMATCH").alias("rule_id"), "left", "right")


@dataclass(frozen=True)
class Artifacts:
    """What a side of a comparison has; fields, findings or totals that either side lacks aren't compared."""

    fields: DataFrame | None = None
    findings: DataFrame | None = None
    totals: DataFrame | None = None
    hashes: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Target:
    """What the expected side is declared as, and in which dimensions it may be compared."""

    status: str = "not_oracle"
    allowed: tuple[str, ...] = DIMENSIONS

    def __post_init__(self):
        if self.status not in STATUSES or not set(self.allowed) <= set(DIMENSIONS):
            raise ValueError(f"unknown status or dimension: {self.status}, {self.allowed}")


def diff_artifacts(left: Artifacts, right: Artifacts, target: Target = Target(), key: str = "record_index") -> DataFrame:
    """rule_id, detail, sorted: where the actual side (right) differs from the expected one (left) in the allowed dimensions.

    A hash that one side alone has differs. Where nothing differs and the target is no admitted oracle, a note says so.
    """
    parts, may = [], set(target.allowed)
    if "field_values" in may and left.fields is not None and right.fields is not None:
        parts.append(diff_fields(left.fields, right.fields, key).select("rule_id", F.concat_ws(" ", F.col(key).cast("string"), "name").alias("detail")))
    if "finding_ids" in may and left.findings is not None and right.findings is not None:
        parts.append(diff_sets(left.findings, right.findings, "rule_id").select("rule_id", F.concat_ws(" ", "side", "value").alias("detail")))
    if "control_totals" in may and left.totals is not None and right.totals is not None:
        parts.append(diff_totals(left.totals, right.totals).select("rule_id", F.concat_ws(" ", "kind", "name").alias("detail")))
    spark = next((x.sparkSession for x in (left.fields, left.findings, left.totals, right.fields, right.findings, right.totals) if x is not None), None) or SparkSession.active()
    fixed = [("DIFF-HASH-MISMATCH", k) for k in sorted(left.hashes.keys() | right.hashes.keys()) if left.hashes.get(k) != right.hashes.get(k)] if "audit_hashes" in may else []
    out = spark.createDataFrame(fixed, "rule_id string, detail string")
    for p in parts:
        out = out.unionByName(p)
    if target.status != ORACLE:
        equal = out.limit(1).agg(F.count("*").alias("n")).where("n = 0")
        out = out.unionByName(equal.select(F.lit("DIFF-TARGET-NOT-ORACLE").alias("rule_id"), F.lit(NOT_ORACLE.format(target.status)).alias("detail")))
    return out.orderBy("rule_id", "detail")


def field_map(df: DataFrame, layout: Layout, rule: Redaction, encoding: str = ASCII) -> DataFrame:
    """Each redacted field with its place, picture, source line, courts and conditions, for tools that show evidence."""
    spark = df.sparkSession
    rows = [(f.name, f.offset, f.size, f.pic.text if f.pic else None, f.usage, f.source, f.line, courts_of(f, layout, encoding), [c.name for c in layout.conditions_of(f.name)]) for f in layout.elementary()]
    known = spark.createDataFrame(rows, "field string, offset int, size int, pic string, usage string, source string, line int, courts array<string>, conditions array<string>")
    return redact(df, layout, rule, encoding).join(F.broadcast(known), "field")  # a row for each field of the layout


VERDICTS = ("pass", "fail_closed", "mismatch", "refused")


@dataclass(frozen=True)
class Fixture:
    """An expected verdict (pass, fail_closed, mismatch or refused) and set of rules; any but a pass must name what it doesn't claim."""

    name: str
    verdict: str
    rules: frozenset[str]
    non_claims: tuple[str, ...] = ()

    def __post_init__(self):
        if self.verdict not in VERDICTS:
            raise ValueError(f"unknown verdict {self.verdict}")


def replay_fixture(fixture: Fixture, verdict: str, findings: DataFrame) -> DataFrame:
    """rule_id, detail of what the replay doesn't meet; no rows where it does."""
    spark = findings.sparkSession
    fixed = []
    if verdict != fixture.verdict:
        fixed.append(("FIXTURE-VERDICT-MISMATCH", f"{fixture.name}: expected {fixture.verdict}, got {verdict}"))
    if fixture.verdict != "pass" and not fixture.non_claims:
        fixed.append(("FIXTURE-NON-CLAIM-REQUIRED", fixture.name))
    want = spark.createDataFrame([(r,) for r in sorted(fixture.rules)], "rule_id string")
    sets = diff_sets(want, findings, "rule_id", "FIXTURE-FINDING-MISMATCH").select("rule_id", F.concat_ws(" ", "side", "value").alias("detail"))
    return spark.createDataFrame(fixed, "rule_id string, detail string").union(sets)


def reconcile_report(totals: DataFrame, findings: DataFrame, sources: dict[str, str]) -> dict[str, str]:
    """A report as json, markdown and sarif text. Totals are a few rows; findings are counted by rule, not listed whole."""
    rows = [r.asDict() for r in totals.collect()]
    rules = [(r["rule_id"], r["n"], r["m"]) for r in findings.groupBy("rule_id").agg(F.count("*").alias("n"), F.min("message").alias("m")).orderBy("rule_id").collect()]
    balanced = all(r["ok"] for r in rows) and not rules
    pins = {k: hashlib.sha256(v.encode()).hexdigest() for k, v in sorted(sources.items())}
    body = {"balanced": balanced, "totals": rows, "findings": [{"rule_id": r, "count": n, "first": m} for r, n, m in rules], "sources": pins, "non_claims": ["posting", "ledger state", "business meaning"]}
    lines = ["# Reconciliation", "", f"Balanced: {'yes' if balanced else 'no'}", "", "| measure | declared | observed | ok |", "|-|-|-|-|"]
    lines += [f"| {r['measure']} | {r['declared']} | {r['observed']} | {r['ok']} |" for r in rows]
    lines += ["", *(f"- {r}: {n}, first: {m}" for r, n, m in rules)]
    sarif = {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "recordloom", "rules": [{"id": r} for r, _, _ in rules]}}, "results": [{"ruleId": r, "level": "warning", "message": {"text": m}, "occurrenceCount": n} for r, n, m in rules]}]}
    return {"json": json.dumps(body, default=str, sort_keys=True), "markdown": "\n".join(lines) + "\n", "sarif": json.dumps(sarif, sort_keys=True)}


REQUIRED = ("redaction", "extract", "casefile")


def pilot_packet(artifacts: dict[str, str], notes: str = "") -> dict:
    """Pins each artifact by sha256; tells which required ones are missing, and a checklist."""
    pins = {k: hashlib.sha256(v.encode()).hexdigest() for k, v in sorted(artifacts.items())}
    missing = [k for k in REQUIRED if k not in artifacts]
    return {
        "artifacts": pins, "findings": [{"rule_id": "PILOT-MISSING-REQUIRED", "detail": k} for k in missing], "complete": not missing,
        "checklist": [{"item": k, "done": k in artifacts} for k in REQUIRED], "notes_sha256": hashlib.sha256(notes.encode()).hexdigest(),
    }


def leaked(artifacts: dict[str, str], secrets: list[str]) -> list[str]:
    """Names of artifacts that hold a cleartext value; to be called before anything is written."""
    return sorted(k for k, v in artifacts.items() if any(s and s in v for s in secrets))
