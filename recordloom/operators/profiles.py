"""Declared profiles: sentinels, dates, amounts, null indicators, redefinitions and redaction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.decode import ASCII, number, raw_bytes, raw_hex, row_each, text_of, valid, value
from recordloom.operators.findings import FINDING
from recordloom.plans.copybook import Layout


@dataclass(frozen=True)
class Sentinel:
    """A field's value (or raw bytes as hex) that stands for something else."""

    field: str
    meaning: str
    value: str | None = None
    raw_hex: str | None = None


def sentinel_scan(df: DataFrame, layout: Layout, rules: tuple[Sentinel, ...], encoding: str = ASCII) -> DataFrame:
    """record_index, field, meaning, value, raw_hex of each declared sentinel that occurs; values are left as they are."""
    hits = []
    for r in rules:
        if not layout.has(r.field):
            continue
        f = layout.field(r.field)
        is_ = (value(f, encoding) == r.value) if r.value is not None else (raw_hex(f) == r.raw_hex.lower())
        hits.append(F.when(is_, F.struct(F.lit(r.field).alias("field"), F.lit(r.meaning).alias("meaning"), value(f, encoding).alias("value"), raw_hex(f).alias("raw_hex"))))
    if not hits:
        return df.sparkSession.createDataFrame([], "record_index long, field string, meaning string, value string, raw_hex string")
    return df.select("record_index", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("record_index", "h.*")


def sentinel_findings(df: DataFrame, layout: Layout, rules: tuple[Sentinel, ...]) -> DataFrame:
    return df.sparkSession.createDataFrame([("SENTINEL-NO-FIELD", "warning", f"no field {r.field}", None) for r in rules if not layout.has(r.field)], FINDING)


@dataclass(frozen=True)
class DateRule:
    """A date field: YYYYMMDD or YYDDD, the digits that are declared to be no date, and whether any that is no date must be."""

    field: str
    format: str = "YYYYMMDD"
    sentinels: tuple[str, ...] = ()
    require_sentinel: bool = False


def _leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def date_status(text: Column, rule: DateRule) -> Column:
    """valid, invalid_format, invalid_calendar or declared_sentinel. Year 0 counts as a year; YYDDD years are 2000 and on."""
    if rule.format == "YYYYMMDD":
        shape = text.rlike("^[0-9]{8}$")
        part = lambda a, n: F.substring(text, a, n).try_cast("int")
        y, m, d = part(1, 4), part(5, 2), part(7, 2)
        days = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(_leap(y), 29).otherwise(28)).otherwise(31)
        good = m.between(1, 12) & (d >= 1) & (d <= days)
    elif rule.format == "YYDDD":
        shape = text.rlike("^[0-9]{5}$")
        y, n = F.substring(text, 1, 2).try_cast("int") + 2000, F.substring(text, 3, 3).try_cast("int")
        good = (n >= 1) & (n <= F.when(_leap(y), 366).otherwise(365))
    else:
        raise ValueError(f"unknown date format {rule.format}")
    known = text.isin(*rule.sentinels) if rule.sentinels else F.lit(False)
    return F.when(known, "declared_sentinel").when(~F.coalesce(shape, F.lit(False)), "invalid_format").when(good, "valid").otherwise("invalid_calendar")


def date_validate(df: DataFrame, layout: Layout, rules: tuple[DateRule, ...], encoding: str = ASCII) -> DataFrame:
    """record_index, field, text, status, rule_ids (empty for valid dates and declared sentinels) for each rule and record.

    The stored bytes are checked as they are, leading zeros included: a packed field holds no digits of text. Under EBCDIC
    they are decoded first. A day that isn't in the calendar has a second finding where the rule requires a sentinel for it.
    """
    items = []
    for r in rules:
        demand = F.lit(r.require_sentinel).alias("demand")
        if not layout.has(r.field):
            items.append(F.struct(F.lit(r.field).alias("field"), F.lit(None).cast("string").alias("text"), F.lit("missing").alias("status"), demand))
            continue
        f = layout.field(r.field)
        text = text_of(raw_bytes(f), encoding if f.usage == "DISPLAY" else ASCII)
        items.append(F.struct(F.lit(r.field).alias("field"), text.alias("text"), date_status(text, r).alias("status"), demand))
    rows = row_each(df, ("record_index",), items, "d").select("record_index", "d.*")
    status = F.col("status")
    found = (
        F.when(status == "missing", F.array(F.lit("DATE-MISSING-FIELD"))).when(status == "invalid_format", F.array(F.lit("DATE-INVALID-FORMAT")))
        .when((status == "invalid_calendar") & F.col("demand"), F.array(F.lit("DATE-INVALID-CALENDAR-DATE"), F.lit("DATE-SENTINEL-UNDECLARED")))
        .when(status == "invalid_calendar", F.array(F.lit("DATE-INVALID-CALENDAR-DATE"))).otherwise(F.array().cast("array<string>"))
    )
    return rows.withColumn("rule_ids", found).drop("demand")


@dataclass(frozen=True)
class CurrencyRule:
    """An amount field: its declared role and scale, the field that holds its currency code, and whether another scale is a finding."""

    amount: str
    role: str
    scale: int
    code: str | None = None
    scale_is_finding: bool = True


def observed_scale(v: Column) -> Column:
    """Digits after the last point of a value's text."""
    return F.length(F.regexp_extract(v, r"\.([^.]*)$", 1))


def currency_validate(df: DataFrame, layout: Layout, rules: tuple[CurrencyRule, ...], encoding: str = ASCII) -> DataFrame:
    """record_index, field, value, observed_scale, code, rule_ids, admitted_as_money for each rule and record.

    All findings of a row are told. The scale is that of the value; a field that isn't an amount is not looked at further. A
    code is evidence, whatever it says; nothing here is admitted as money.
    """
    items = []
    for r in rules:
        none, f = F.lit(None).cast("string"), layout.field(r.amount) if layout.has(r.amount) else None
        v, code, scale, found = none if f is None else value(f, encoding), none, F.lit(None).cast("int"), []
        if f is None:
            found = [F.lit("CURRENCY-MISSING-FIELD")]
        elif r.role != "amount":
            found = [F.lit("CURRENCY-ROLE-NOT-AMOUNT")]
        else:
            scale = observed_scale(v)
            if r.scale_is_finding:
                found.append(F.when(scale != r.scale, F.lit("CURRENCY-SCALE-MISMATCH")))
            if r.code and layout.has(r.code):
                code = F.trim(value(layout.field(r.code), encoding))
            elif r.code:
                found.append(F.lit("CURRENCY-MISSING-CODE"))
        items.append(F.struct(F.lit(r.amount).alias("field"), v.alias("value"), scale.alias("observed_scale"), code.alias("code"), F.array_compact(F.array(*found).cast("array<string>")).alias("rule_ids"), F.lit(False).alias("admitted_as_money")))
    return row_each(df, ("record_index",), items, "c").select("record_index", "c.*")


@dataclass(frozen=True)
class Indicator:
    """A value and the binary indicator that says whether it is null."""

    value: str
    indicator: str


def null_indicators(df: DataFrame, layout: Layout, pairs: tuple[Indicator, ...], encoding: str = ASCII) -> DataFrame:
    """record_index, field, status (null, present, truncated), value (null where the indicator says so), original_length, rule_id."""
    items = []
    for p in pairs:
        rule = "DB2-MISSING-VALUE-FIELD" if not layout.has(p.value) else "DB2-MISSING-INDICATOR" if not layout.has(p.indicator) else None
        i = layout.field(p.indicator) if rule is None else None
        if i is not None and (i.category != "numeric" or i.usage not in ("COMP", "COMP-5", "COMP-X")):
            rule = "DB2-WRONG-INDICATOR-USAGE"
        none = F.lit(None).cast("string")
        if rule:
            items.append(F.struct(F.lit(p.value).alias("field"), none.alias("status"), none.alias("value"), F.lit(None).cast("long").alias("original_length"), F.lit(rule).alias("rule_id")))
            continue
        n = number(i, encoding)
        status = F.when(n < 0, "null").when(n == 0, "present").when(n > 0, "truncated")
        items.append(F.struct(
            F.lit(p.value).alias("field"), status.alias("status"), F.when(n >= 0, value(layout.field(p.value), encoding)).alias("value"),
            F.when(n > 0, n.cast("long")).alias("original_length"), F.when(~valid(i, encoding), "DB2-DIRTY-INDICATOR").alias("rule_id"),
        ))
    return row_each(df, ("record_index",), items, "i").select("record_index", "i.*")


def redefined_views(layout: Layout) -> dict[str, tuple[str, ...]]:
    """Each region that is redefined, with the names of all views of its bytes."""
    out: dict[str, tuple[str, ...]] = {}
    for f in layout.fields:
        if f.redefines:
            out[f.redefines] = (*out.get(f.redefines, (f.redefines,)), f.name)
    return out


def redefines_manifest(df: DataFrame, layout: Layout, region: str, discriminator: str | None = None, active: dict[str, str] | None = None, encoding: str = ASCII) -> DataFrame:
    """record_index, view, field, value, active: each view's fields over the same bytes.

    A view is active only where the discriminator's value declares it; without one, none is.
    """
    views = redefined_views(layout)[region]
    d = value(layout.field(discriminator), encoding) if discriminator else None
    items = []
    for v in views:
        top = layout.field(v)
        inside = [f for f in layout.elementary() if f.name == v or f.group == v]
        on = F.lit(False)
        for val, name in (active or {}).items():
            if name == v and d is not None:
                on = on | (d == val)
        items += [F.struct(F.lit(top.name).alias("view"), F.lit(f.name).alias("field"), value(f, encoding).alias("value"), on.alias("active")) for f in inside]
    return row_each(df, ("record_index",), items, "v").select("record_index", "v.*")


@dataclass(frozen=True)
class Redaction:
    """Actions by field: allow, hash (the value goes), hash_only (raw bytes go, too) or token. Others are denied or allowed.

    A denied field and one under ``hash`` lose their raw bytes as well, since these tell the value. ``keep_raw`` keeps them, which
    is what the published rule does; a denied field is then under ``hash``.
    """

    scope: str
    actions: dict[str, str]
    unlisted: str = "deny"
    keep_raw: bool = False
    key: str | None = None


def token(v: Column, scope: str, key: str | None = None) -> Column:
    """A stable token of a value within a scope; a key makes it hard to guess from a list of likely values."""
    salt = F.lit(f"{scope}:" if key is None else f"{scope}:{key}:")
    return F.concat(F.lit("TOK-"), F.substring(F.sha2(F.concat(salt, v), 256), 1, 12))


def redact(df: DataFrame, layout: Layout, rule: Redaction, encoding: str = ASCII) -> DataFrame:
    """record_index, field, action, redacted, value, value_sha256, raw_sha256, raw_hex, rule_id; both hashes stay under every action."""
    items = []
    for f in layout.elementary():
        listed = rule.actions.get(f.name)
        action = listed or ("allow" if rule.unlisted == "allow" else "hash" if rule.keep_raw else "hash_only")
        if action not in ("allow", "hash", "hash_only", "token"):
            raise ValueError(f"unknown action {action}")
        v, none = value(f, encoding), F.lit(None).cast("string")
        shown = v if action == "allow" else token(v, rule.scope, rule.key) if action == "token" else none
        raw = raw_hex(f) if action == "allow" or (rule.keep_raw and action == "hash") else none
        items.append(F.struct(
            F.lit(f.name).alias("field"), F.lit(action).alias("action"), F.lit(action != "allow").alias("redacted"), shown.alias("value"), F.sha2(v, 256).alias("value_sha256"), F.sha2(raw_bytes(f), 256).alias("raw_sha256"), raw.alias("raw_hex"),
            F.lit(None if listed or rule.unlisted == "allow" else "PRIVACY-UNLISTED-FIELD").cast("string").alias("rule_id"),
        ))
    return row_each(df, ("record_index",), items, "r").select("record_index", "r.*")


def extract_manifest(df: DataFrame, layout: Layout, unit: str, declared: dict[str, str]) -> DataFrame:
    """unit, declared provenance, records, content_sha256 (over records in order) and copybook_sha256."""
    from hashlib import sha256

    from recordloom.operators.custody import record_chain

    return record_chain(df).select(
        F.lit(unit).alias("unit"), F.create_map(*(F.lit(x) for kv in sorted(declared.items()) for x in kv)).alias("declared") if declared else F.lit(None).cast("map<string,string>").alias("declared"),
        "records", F.col("hash").alias("chain_sha256"), F.lit(sha256(layout.text.encode()).hexdigest()).alias("copybook_sha256"),
    )


def date_findings(checked: DataFrame) -> DataFrame:
    """The findings of date_validate's rows."""
    rows = checked.select("record_index", "field", "status", F.explode("rule_ids").alias("rule_id"))
    return rows.select("rule_id", F.lit("warning").alias("level"), F.concat_ws(": ", "field", "status").alias("message"), F.col("record_index").cast("long").alias("record_index"))
