"""Reconciliation: decoded JSON lines with their audit, control totals, field explanations, dirty data and transforms."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from recordloom.functions.decode import ASCII, CP500, SHORT, condition, number, raw_bytes, raw_hex, row_each, valid, value
from recordloom.functions.encode import encode_number, encode_text
from recordloom.operators.custody import file_digest, ordered_digest
from recordloom.operators.findings import FINDING, finding
from recordloom.plans.copybook import Condition, Field, Layout, compile_layout, no_copy
from recordloom.sources.fixedrec import files_of

STALE_RISK = "the copybook is declared by the caller; a stale one decodes to plausible values"


def _json(*columns: Column, nulls: bool = False) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": str(not nulls).lower()})


def json_escapes(line: Column, short: bool = True) -> Column:
    """JSON text with control characters as \\u00xx in lower case; with ``short`` line feed, return and tab keep their two characters."""
    even = r"(?<!\\)((?:\\\\)*)"
    long = {"b": 8, "f": 12} | ({} if short else {"n": 10, "r": 13, "t": 9})
    out = line
    for c, n in long.items():
        out = F.regexp_replace(out, even + r"\\" + c, f"$1\\\\u{n:04x}")
    for n in (11, 14, 15, *range(26, 32)):
        out = F.regexp_replace(out, even + rf"\\u{n:04X}", f"$1\\\\u{n:04x}")
    return F.when(line.rlike(r"\\[bfu]" if short else r"\\[bfunrt]"), out).otherwise(line)


def _places(layout: Layout, *categories: str) -> list[tuple[int, Field]]:
    """Fields of some categories, with their places among the elementary ones."""
    return [(i, f) for i, f in enumerate(layout.elementary()) if f.category in categories]


def _decoded(df: DataFrame, layout: Layout, encoding: str) -> DataFrame:
    """record_index, raw_offset, raw_len and d, of which both lines and totals are made, so that no field is decoded twice.

    d has the record's size and hash; by a field's place its number n, text t or validity v; by a condition's place its truth c.
    """
    layout.check_keys()
    d = [F.length("record").alias("size"), F.sha2("record", 256).alias("hash")]
    d += [number(f, encoding).alias(f"n{i}") for i, f in _places(layout, "numeric")]
    d += [value(f, encoding).alias(f"t{i}") for i, f in _places(layout, "alphanumeric", "edited")]
    for i, f in _places(layout, "edited"):
        d += [valid(f, encoding).alias(f"v{i}"), (number(f, encoding).cast("string") if encoding == ASCII else F.lit(None).cast("string")).alias(f"n{i}")]
    d += [condition(c, layout, encoding).alias(f"c{i}") for i, c in enumerate(layout.conditions)]
    return row_each(df, ("record_index", "raw_offset", "raw_len"), [F.struct(*d)], "d")


def _lines(decoded: DataFrame, layout: Layout, claim: str = "edited-picture") -> DataFrame:
    """record_index, line, unsupported (names) of ``_decoded`` records. Escapes stand in texts of fields alone."""
    told, conditions = _places(layout, "numeric", "alphanumeric", "edited"), list(enumerate(layout.conditions))
    key = lambda name: F.lit(json.dumps(name, ensure_ascii=False) + ":")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    fits = lambda f: F.col("d.size") >= f.offset + f.size
    texts = [F.when(fits(f), F.col(f"d.n{i}").cast("string")).otherwise(F.lit(SHORT)) if f.category == "numeric" else F.col(f"d.t{i}") for i, f in told]
    fields = _json(*(t.alias(f.name) for t, (_, f) in zip(texts, told, strict=True))) if told else F.lit("{}")
    odd = [F.lit(f"field:{f.name}") for _, f in _places(layout, "unsupported")] + [F.when(F.col(f"d.c{i}").isNull(), F.lit(f"condition:{c.name}")) for i, c in conditions]
    # what is escaped is made once, though its escapes look at it several times
    once = row_each(decoded, ("record_index", "raw_offset", "raw_len", "d"), [fields], "fields")
    truths = [F.concat(key(c.name), F.col(f"d.c{i}").cast("string")) for i, c in conditions]
    audit = [F.concat(key(k), F.col(k).cast("string")) for k in ("raw_offset", "raw_len")] + [F.concat(key("record_sha256"), quoted(F.col("d.hash")))]
    end = F.lit(f',"claim":{json.dumps(claim, ensure_ascii=False)},"domain":"edited-display-decode"}}')
    each = [F.concat(key(f.name), F.lit('{"raw_text":'), quoted(F.col(f"d.t{i}")), F.lit(',"numeric_value":'), F.coalesce(quoted(F.col(f"d.n{i}")), F.lit("null")), end) for i, f in _places(layout, "edited")]
    block = [F.lit(',"edited":{'), F.concat_ws(",", *each), F.lit("}")] if each else []
    line = F.concat(F.lit('{"record_index":'), F.col("record_index").cast("string"), F.lit(',"fields":'), json_escapes(F.col("fields")), F.lit(',"conditions":{'), F.concat_ws(",", *truths), F.lit('},"audit":{'), F.concat_ws(",", *audit), *block, F.lit("}}"))
    return once.select("record_index", line.alias("line"), F.array_compact(F.array(*odd).cast("array<string>")).alias("unsupported"))


def record_json(df: DataFrame, layout: Layout, encoding: str = ASCII, claim: str = "edited-picture") -> DataFrame:
    """record_index, line, unsupported (names): one JSON object a record with fields, conditions and audit, in layout order."""
    return _lines(_decoded(df, layout, encoding), layout, claim)


def unsupported_ledger(lines: DataFrame) -> DataFrame:
    """item, records: every unsupported item of any record, and in how many."""
    return lines.select(F.explode("unsupported").alias("item")).groupBy("item").agg(F.count("*").alias("records"))


def unsupported_summary(lines: DataFrame) -> DataFrame:
    """unsupported, unsupported_count: the unsupported items of the first record, and how many all records have together."""
    first = F.coalesce(F.min_by("unsupported", "record_index"), F.array().cast("array<string>"))
    return lines.agg(first.alias("unsupported"), F.coalesce(F.sum(F.size("unsupported")), F.lit(0)).alias("unsupported_count"))


def audit_receipt(df: DataFrame, lines: DataFrame, layout: Layout, fixture: str, encoding: str = ASCII) -> DataFrame:
    """One row: the hashes of input texts, layout and output, and the counts."""
    out = ordered_digest(lines, "record_index", "line").select(F.col("hash").alias("decode_output_sha256"), F.col("records").alias("record_count"))
    n = lines.agg(F.coalesce(F.sum(F.size("unsupported")), F.lit(0)).alias("unsupported_count"))
    digest = lambda s: F.lit(hashlib.sha256(s.encode()).hexdigest())
    usages = {f.usage for f in layout.elementary() if f.category == "numeric"}
    return out.crossJoin(n).select(
        F.lit(fixture).alias("fixture"), digest(layout.text).alias("copybook_sha256"), digest(layout.expanded).alias("expanded_copybook_sha256"), F.lit(layout.layout_hash).alias("layout_hash"),
        "record_count", F.lit(len(layout.elementary())).alias("field_count"), F.lit(len(layout.conditions)).alias("condition_count"), "unsupported_count", "decode_output_sha256",
        F.lit(bool(usages & {"COMP", "COMP-5", "COMP-X"})).alias("has_binary"), F.lit("COMP-6" in usages).alias("has_comp6"), F.lit(encoding).alias("encoding"), F.lit(STALE_RISK).alias("stale_copybook_risk"),
    )


@dataclass(frozen=True)
class Reconciliation:
    """lines (record_index, line, unsupported), the audit receipt, and the unsupported ledger, by item and in sum."""

    lines: DataFrame
    receipt: DataFrame
    ledger: DataFrame
    summary: DataFrame


def reconcile(df: DataFrame, layout: Layout, fixture: str, encoding: str = ASCII) -> Reconciliation:
    """Everything that is told of a file of records (record_index, raw_offset, raw_len, record)."""
    lines = record_json(df, layout, encoding)
    return Reconciliation(lines, audit_receipt(df, lines, layout, fixture, encoding), unsupported_ledger(lines), unsupported_summary(lines))


def reconcile_profile(df: DataFrame, copybook: str, fixture: str, resolver: Callable[[str], str | None] | dict[str, str] = no_copy, encoding: str = ASCII) -> tuple[Reconciliation, dict[str, float]]:
    """The same from a copybook's text, and the seconds of its stages: parse, record (all lines made once), aggregate (the receipt)."""
    began = time.perf_counter()
    layout = compile_layout(copybook, resolver)
    parsed = time.perf_counter()
    made = reconcile(df, layout, fixture, encoding)
    made.lines.write.format("noop").mode("overwrite").save()
    lined = time.perf_counter()
    made.receipt.collect()  # one row
    return made, {"parse": parsed - began, "record": lined - parsed, "aggregate": time.perf_counter() - lined}


def _total_aggs(layout: Layout, number_of: Callable[[Field], Column], is_valid: Callable[[Field], Column], holds: Callable[[Condition], Column]) -> list[Column]:
    """What ``_total_rows`` needs of the records, as named aggregates. A numeric field has a number just where its bytes are valid,
    so its sum and its counts come from one decoding."""
    layout.check_keys()
    numeric = [f for f in layout.elementary() if f.category == "numeric"]
    other = [f for f in layout.elementary() if f.category in ("alphanumeric", "edited")]
    aggs = [F.count("*").alias("n")]
    numbers = [number_of(f) for f in numeric]
    aggs += [F.sum(v.cast(f"decimal(38,{f.pic.scale})")).alias(f"s{i}") for i, (f, v) in enumerate(zip(numeric, numbers, strict=True))]
    aggs += [(F.count("*") - F.count(v)).alias(f"i{i}") for i, v in enumerate(numbers)]
    aggs += [F.count_if(~is_valid(f)).alias(f"i{i}") for i, f in enumerate(other, len(numeric))]
    return aggs + [F.count_if(holds(c)).alias(f"c{i}") for i, c in enumerate(layout.conditions)]


def _decoded_aggs(layout: Layout) -> list[Column]:
    """The same aggregates over ``_decoded`` records."""
    place = {f.name: i for i, f in enumerate(layout.elementary())}
    truth = {id(c): i for i, c in enumerate(layout.conditions)}
    is_valid = lambda f: F.col("d.size") >= f.offset + f.size if f.category == "alphanumeric" else F.col(f"d.v{place[f.name]}")
    return _total_aggs(layout, lambda f: F.col(f"d.n{place[f.name]}"), is_valid, lambda c: F.col(f"d.c{truth[id(c)]}"))


def _total_rows(one: DataFrame, layout: Layout) -> DataFrame:
    """kind, name, total, count out of the one row of aggregates."""
    numeric = [f for f in layout.elementary() if f.category == "numeric"]
    other = [f for f in layout.elementary() if f.category in ("alphanumeric", "edited")]
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    row = lambda kind, name, total, count: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), total.alias("total"), count.alias("count"))
    rows = [row("records", "", none, F.col("n"))]
    rows += [row("sum", f.name, F.coalesce(F.col(f"s{i}").cast("string"), F.lit(Decimal(0).scaleb(-f.pic.scale)).cast("string")), F.col("n") - F.col(f"i{i}")) for i, f in enumerate(numeric)]
    rows += [row("invalid", f.name, none, F.col(f"i{i}")) for i, f in enumerate(numeric + other)]
    rows += [row("condition", c.name, none, F.col(f"c{i}")) for i, c in enumerate(layout.conditions)]
    rows += [row("unsupported", f.name, none, F.col("n")) for f in layout.elementary() if f.category == "unsupported"]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("count", F.coalesce("count", zero))


def control_totals(df: DataFrame, layout: Layout, encoding: str = ASCII) -> DataFrame:
    """kind, name, total, count: records, exact sums of valid numeric values, true conditions, invalid and unsupported counts.

    One aggregation over the scan; sums are exact decimals that fail on overflow rather than saturate.
    """
    numbers = lambda f: F.when(F.length("record") >= f.offset + f.size, number(f, encoding))
    return _total_rows(df.agg(*_total_aggs(layout, numbers, lambda f: valid(f, encoding), lambda c: condition(c, layout, encoding))), layout)


@dataclass(frozen=True)
class Pass:
    """What one pass over the records has left: the folder of lines, control totals, and seconds of its stages.

    output has the hash of all lines in order and their number. One task streams the lines for it, when it is asked for: a job that
    has other work can do both side by side.
    """

    lines: DataFrame
    totals: DataFrame
    ledger: DataFrame
    output: DataFrame
    records: int
    seconds: dict[str, float]

    @cached_property
    def output_sha256(self) -> str:
        began = time.perf_counter()
        out = self.output.first()
        if out["records"] != self.records:
            raise RuntimeError(f"{out['records']} lines were written of {self.records} records")
        self.seconds["aggregate"] += time.perf_counter() - began
        return out["hash"]


def _in_files(lines: DataFrame) -> int:
    """How many lines a folder's files have. The tasks that wrote them (part-00000-...) must have had ranges of numbers that follow each other."""
    files = lines.groupBy(F.substring_index("_metadata.file_name", "-", 2).alias("task")).agg(F.min("record_index").alias("low"), F.max("record_index").alias("high"), F.count("*").alias("n"))
    before = F.lag("high").over(Window.orderBy("task"))  # a row for each task
    told = files.select("n", (F.col("low") <= before).alias("mixed")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if("mixed").alias("mixed")).first()
    if told["mixed"]:
        raise ValueError(f"{told['mixed']} partitions of the records don't begin beyond the one before them")
    return told["n"]


def reconcile_pass(df: DataFrame, copybook: str, folder: str, resolver: Callable[[str], str | None] | dict[str, str] = no_copy, encoding: str = ASCII, ranges: int | None = None, placed: bool = False) -> Pass:
    """Lines, control totals and the unsupported ledger of a file of records (record_index, raw_offset, raw_len, record) out of one job.

    Records are ordered by ranges first. The job that then makes and writes the lines gathers all totals while it does so, in
    its last stage, where a task that is run again counts once. A range of records is one task's, which sorts their lines: many times the bytes
    by which Spark would size it, so ``ranges`` can be given. With ``placed``, df's partitions are such ranges already, one after the other; if
    they turn out not to be, the pass fails. folder must be new; its files follow each other in record order,
    lines of equal numbers by their text as in ``ordered_digest``, so the digest of the output streams them as they are. Seconds are those of parse, record and aggregate, which has the digest's once that is made.
    """
    began = time.perf_counter()
    layout = compile_layout(copybook, resolver)
    parsed = time.perf_counter()
    spark, seen = df.sparkSession, Observation()
    ordered = df.select("record_index", "raw_offset", "raw_len", "record")
    if not placed:
        ordered = ordered.repartitionByRange(ranges, "record_index") if ranges else ordered.repartitionByRange("record_index")
    decoded, aggs = _decoded(ordered, layout, encoding), _decoded_aggs(layout)
    kinds = decoded.agg(*aggs).schema
    made = _lines(decoded.observe(seen, *aggs), layout)
    made.sortWithinPartitions("record_index", "line").write.parquet(folder)
    lined = time.perf_counter()
    lines = spark.read.schema("record_index long, line string, unsupported array<string>").parquet(folder)
    totals = _total_rows(spark.createDataFrame([tuple(seen.get[k] for k in kinds.names)], kinds), layout)
    n = _in_files(lines)
    if n != seen.get["n"]:
        raise RuntimeError(f"{n} lines were written of {seen.get['n']} records")
    return Pass(lines, totals, unsupported_ledger(lines), file_digest(spark, files_of(folder), "line"), n, {"parse": parsed - began, "record": lined - parsed, "aggregate": time.perf_counter() - lined})


def courts_of(f: Field, layout: Layout, encoding: str = ASCII) -> list[str]:
    """What took part in a field's value, for the trail of evidence."""
    out = ["picture", "layout"] + (["copy-replacing"] if layout.used_copy else [])
    if f.category == "numeric":
        out.append({"COMP-3": "packed", "COMP-6": "packed-unsigned", "DISPLAY": "zoned-ebcdic" if encoding == CP500 else "display"}.get(f.usage, "binary"))
    elif f.category == "alphanumeric":
        out.append("text-ebcdic" if encoding == CP500 else "text")
    elif f.category == "edited":
        out.append("edited-picture")
    return out + (["condition"] if layout.conditions_of(f.name) else [])


NON_CLAIMS = ("business meaning", "posting", "ledger state")


def explain_field(df: DataFrame, layout: Layout, name: str, record_index: int, encoding: str = ASCII) -> DataFrame:
    """Where a field of one record comes from and what its bytes are: provenance, offset, raw, value, validity, courts.

    ``nth_record`` hands over one record's bytes alone; of a larger df the record is filtered out.
    """
    f = layout.field(name)
    lits = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return df.where(F.col("record_index") == record_index).select(
        "record_index", F.lit(f.name).alias("name"), F.lit(f.pic.text if f.pic else None).cast("string").alias("pic"), F.lit(f.usage).alias("usage"), F.lit(f.source).alias("source"), F.lit(f.line).alias("line"),
        F.lit(f.offset).alias("offset"), F.lit(f.size).alias("size"), raw_hex(f).alias("raw_hex"), value(f, encoding).alias("value"), valid(f, encoding).alias("valid"),
        lits(courts_of(f, layout, encoding)).alias("courts"), lits([c.name for c in layout.conditions_of(f.name)]).alias("dependents"), F.sha2(raw_bytes(f), 256).alias("raw_sha256"), lits(NON_CLAIMS).alias("non_claims"),
    )


def dirty_fields(df: DataFrame, layout: Layout, encoding: str = ASCII) -> DataFrame:
    """record_index, invalid: names of fields whose bytes aren't values of their storage, edited and short ones included."""
    names = F.array_compact(F.array(*(F.when(~valid(f, encoding), F.lit(f.name)) for f in layout.elementary() if f.category != "unsupported")).cast("array<string>"))
    return df.select("record_index", names.alias("invalid"))


def strict_decode(df: DataFrame, layout: Layout, encoding: str = ASCII) -> DataFrame:
    """The rows of ``df``; fails on reading if any record has an invalid field, naming the first such record."""
    first = dirty_fields(df, layout, encoding).where(F.size("invalid") > 0).agg(F.min(F.struct("record_index", "invalid")).alias("bad"))
    checked = first.select(F.when(F.col("bad").isNotNull(), F.raise_error(F.concat(F.lit("record "), F.col("bad.record_index").cast("string"), F.lit(": invalid "), F.array_join("bad.invalid", ", ")))).alias("__no"))
    return df.crossJoin(F.broadcast(checked)).where("__no is null").drop("__no")


@dataclass(frozen=True)
class Transform:
    """kind is set_true (target: a condition), add or subtract (target: a numeric field, amount: a literal)."""

    kind: str
    target: str
    amount: str | None = None


def transform(df: DataFrame, layout: Layout, what: Transform, encoding: str = ASCII) -> tuple[DataFrame, DataFrame]:
    """Rows with before, after (record bytes) and changed, and findings. A record that can't take the change keeps its bytes.

    Sums are exact and truncate to the target's scale; one that doesn't fit its digits is a size error and changes nothing.
    """
    spark = df.sparkSession
    fail = lambda rule, text: (df.select("record_index", F.col("record").alias("before"), F.col("record").alias("after"), F.lit(False).alias("changed")), spark.createDataFrame([(rule, "error", text, None)], FINDING))
    if what.kind == "set_true":
        c = next((c for c in layout.conditions if c.name == what.target), None)
        if c is None:
            return fail("TRANSFORM-UNDECLARED-CONDITION", f"no condition {what.target}")
        f, low = layout.field(c.parent), c.values[0][0]
        new = encode_text(F.lit(low), f.size, encoding) if f.category == "alphanumeric" else encode_number(F.lit(Decimal(low)), f, encoding) if f.category == "numeric" else None
        if new is None:
            return fail("TRANSFORM-SET-FAILED", f"{f.name} has no storage for a condition")
    elif what.kind in ("add", "subtract"):
        if not layout.has(what.target):
            return fail("TRANSFORM-UNDECLARED-FIELD", f"no field {what.target}")
        f = layout.field(what.target)
        if f.category != "numeric":
            return fail("TRANSFORM-NOT-NUMERIC", f"{f.name} is {f.category}")
        try:
            amount = Decimal(what.amount or "")
        except InvalidOperation:
            return fail("TRANSFORM-NO-AMOUNT", "the amount is not a number")
        now = number(f, encoding).cast("decimal(38,10)")
        new = encode_number(now + F.lit(amount) if what.kind == "add" else now - F.lit(amount), f, encoding)
    else:
        raise ValueError(f"unknown transform {what.kind}")
    spliced = F.concat(F.substring("record", 1, f.offset), new, F.expr(f"substring(record, {f.offset + f.size + 1})"))
    fits = F.length("record") >= f.offset + f.size
    rows = df.select("record_index", F.col("record").alias("before"), F.when(fits, spliced).alias("made"), fits.alias("fits"))
    out = rows.select("record_index", "before", F.coalesce("made", "before").alias("after"), (F.col("made").isNotNull() & (F.col("made") != F.col("before"))).alias("changed"))
    bad = rows.where("made is null").select(F.when(~F.col("fits"), finding("TRANSFORM-SIZE", F.lit("record too short for field"), "record_index")).otherwise(finding("TRANSFORM-ARITH-FAILED", F.lit("no valid value or size error"), "record_index")).alias("f")).select("f.*")
    return out, bad


def transform_delta(changed: DataFrame, layout: Layout, encoding: str = ASCII) -> DataFrame:
    """record_index, name, before, after of each field whose value a transform changed.

    A row holds both of a record's states, so its fields are compared where they are: nothing is joined or shuffled.
    """
    pairs = [F.struct(F.lit(f.name).alias("name"), value(f, encoding, "before").alias("before"), value(f, encoding, "after").alias("after")) for f in layout.elementary()]
    fields = row_each(changed.where(~F.col("before").eqNullSafe(F.col("after"))), ("record_index",), pairs, "f")
    return fields.select("record_index", "f.*").where(~F.col("before").eqNullSafe(F.col("after")))
