"""Routing of records by type, and reconciliation of details with trailers."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from recordloom.functions.decode import ASCII, number, typed, valid
from recordloom.operators.findings import FINDING, finding
from recordloom.plans.copybook import Layout
from recordloom.sources.fixedrec import new_folder

#: What a numeric field is for; only amounts are summed.
ROLES = ("amount", "identifier", "rate", "code", "count", "date", "quantity")


@dataclass(frozen=True)
class Variant:
    """A record type: its name, the bytes that tell it, and its layout."""

    name: str
    discriminator: bytes
    layout: Layout


@dataclass(frozen=True)
class VariantSpec:
    """Where the discriminator lies, and the types in order; the first that matches decodes."""

    offset: int
    length: int
    variants: tuple[Variant, ...]

    def route(self, record: str = "record") -> Column:
        """The variant's name; null where none matches."""
        disc = F.substring(record, self.offset + 1, self.length)
        out = F.lit(None).cast("string")
        for v in reversed(self.variants):
            out = F.when(disc == F.lit(v.discriminator), F.lit(v.name)).otherwise(out)
        return out


def printable(c: Column) -> Column:
    """Bytes as text with a dot for whatever doesn't print."""
    return F.regexp_replace(F.decode(c, "ISO-8859-1"), "[^\\x20-\\x7E]", ".")


def variant_route(df: DataFrame, spec: VariantSpec) -> DataFrame:
    """df with variant (null: refused) and discriminator, as hex and printable."""
    disc = F.substring("record", spec.offset + 1, spec.length)
    return df.withColumns({"variant": spec.route(), "disc_hex": F.lower(F.hex(disc)), "disc_text": printable(disc)})


def variant_counts(df: DataFrame, spec: VariantSpec) -> DataFrame:
    """variant, records: every declared type, zeros included, and (unknown). One aggregation."""
    one = df.select(spec.route().alias("v")).agg(*(F.count_if(F.col("v") == v.name).alias(f"c{i}") for i, v in enumerate(spec.variants)), F.count_if(F.col("v").isNull()).alias("none"))
    rows = [F.struct(F.lit(v.name).alias("variant"), F.col(f"c{i}").alias("records")) for i, v in enumerate(spec.variants)]
    return one.select(F.explode(F.array(*rows, F.struct(F.lit("(unknown)").alias("variant"), F.col("none").alias("records")))).alias("r")).select("r.*")


def decode_variant(df: DataFrame, spec: VariantSpec, name: str, encoding: str = ASCII) -> DataFrame:
    """The records of one type with that type's columns."""
    v = next(v for v in spec.variants if v.name == name)
    return df.where(F.coalesce(spec.route() == name, F.lit(False))).select("*", *(typed(f, encoding).alias(f.name) for f in v.layout.elementary()))


def decode_variants(df: DataFrame, spec: VariantSpec, encoding: str = ASCII) -> DataFrame:
    """df with variant (null: refused) and fields, which has a struct for each declared type: null but for the record's own.

    All types are decoded in the same pass over the records. A record is typed by the first type whose discriminator it has;
    of two fields with one name in a type's layout the query would lose one, so these are refused.
    """
    for v in spec.variants:
        v.layout.check_keys()
    kind = spec.route()
    own = [F.when(kind == v.name, F.struct(*(typed(f, encoding).alias(f.name) for f in v.layout.elementary()))).alias(v.name) for v in spec.variants]
    return df.select("*", kind.alias("variant"), F.struct(*own).alias("fields"))


@dataclass(frozen=True)
class Control:
    """Which variants are detail and trailer, what is summed by which polarity, and where the trailer declares totals."""

    detail: str
    trailer: str
    amount: str
    source: str
    debits: tuple[str, ...]
    credits: tuple[str, ...]
    trailer_count: str
    trailer_debit: str
    trailer_credit: str
    roles: dict[str, str] = field(default_factory=dict, hash=False)


def reconcile_banking(df: DataFrame, spec: VariantSpec, control: Control, encoding: str = ASCII) -> tuple[DataFrame, DataFrame]:
    """Totals (measure, declared, observed, ok) and findings.

    Polarity comes only from the declared values of the source field, never from a sign. The last trailer counts. Without the
    role ``amount`` the amount field is not summed at all. An amount must have exactly two decimals and a declared count none:
    others are not rounded, a detail is dirty and a trailer declares nothing.

    The records are read once, here: the job that writes the findings on records gathers all that is observed while it does so, in its
    last stage, where a task that is run again counts once.
    """
    spark = df.sparkSession
    layout = {v.name: v.layout for v in spec.variants}
    d, t = layout[control.detail], layout[control.trailer]
    consistent = control.roles.get(control.amount) == "amount"
    kind = spec.route()
    amount, source = d.field(control.amount), d.field(control.source)
    cents, whole = (lambda f: f.pic is not None and f.pic.scale == 2), (lambda f: f.pic is not None and f.pic.scale == 0)
    declared = lambda f, fits: F.when(valid(f, encoding), number(f, encoding)).cast("decimal(38,2)") if fits(f) else F.lit(None).cast("decimal(38,2)")
    count = declared(t.field(control.trailer_count), whole)
    rows = df.select(
        "record_index", kind.alias("kind"), F.lower(F.hex(F.substring("record", spec.offset + 1, spec.length))).alias("disc"), number(amount, encoding).cast("decimal(38,2)").alias("amount"),
        (valid(amount, encoding) & F.lit(cents(amount))).alias("amount_ok"), F.trim(typed(source, encoding).cast("string")).alias("polarity"), valid(source, encoding).alias("source_ok"),
        F.when(count >= 0, count).alias("t_count"), declared(t.field(control.trailer_debit), cents).alias("t_debit"), declared(t.field(control.trailer_credit), cents).alias("t_credit"),
    )
    is_detail, is_trailer = F.col("kind") == control.detail, F.col("kind") == control.trailer
    clean = is_detail & F.col("amount_ok") & F.col("source_ok")
    debit, credit = clean & F.col("polarity").isin(*control.debits), clean & F.col("polarity").isin(*control.credits)
    none = F.lit(None).cast("decimal(38,2)")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("amount"))), F.lit(Decimal("0.00"))) if consistent else none
    last = lambda c: F.max_by(F.when(is_trailer, F.col(c)), F.when(is_trailer, F.col("record_index"))).cast("decimal(38,2)")
    seen = [F.count_if(is_detail).cast("decimal(38,2)").alias("n"), total(debit).cast("decimal(38,2)").alias("debit"), total(credit).cast("decimal(38,2)").alias("credit"), *(last(c).alias(c) for c in ("t_count", "t_debit", "t_credit"))]
    row = lambda m, dec, obs: F.struct(F.lit(m).alias("measure"), F.col(dec).alias("declared"), F.col(obs).alias("observed"), F.coalesce(F.col(dec) == F.col(obs), F.lit(False)).alias("ok"))
    index = F.col("record_index").cast("string")
    kind_of = (
        F.when(F.col("kind").isNull(), finding("BANK-UNKNOWN-RECORD-TYPE", F.concat(F.lit("record "), index, F.lit(": unknown discriminator "), F.coalesce("disc", F.lit(""))), "record_index"))
        .when(is_detail & ~(F.col("amount_ok") & F.col("source_ok")), finding("BANK-DIRTY-DETAIL", F.concat(F.lit("record "), index, F.lit(": amount or polarity is not cleanly decodable")), "record_index"))
        .when(clean & ~debit & ~credit, finding("BANK-UNKNOWN-POLARITY", F.concat(F.lit("record "), index, F.lit(": polarity "), F.col("polarity"), F.lit(" is not declared")), "record_index"))
    )
    observed, folder = Observation(), new_folder(spark, "bank-findings")
    rows.observe(observed, *seen).select(kind_of.alias("f")).where("f is not null").select("f.*").write.parquet(folder)
    found = spark.read.schema(FINDING).parquet(folder)
    kinds = rows.agg(*seen).schema
    one = spark.createDataFrame([tuple(observed.get[k] for k in kinds.names)], kinds)
    totals = one.select(F.explode(F.array(row("record_count", "t_count", "n"), row("debit_total", "t_debit", "debit"), row("credit_total", "t_credit", "credit"))).alias("r")).select("r.*")
    compare = F.when(F.col("declared").isNull(), finding("BANK-NO-TRAILER", F.concat(F.col("measure"), F.lit(": no declared trailer total")))).otherwise(finding("BANK-CONTROL-MISMATCH", F.concat(F.col("measure"), F.lit(": declared "), F.col("declared").cast("string"), F.lit(" != observed "), F.coalesce(F.col("observed").cast("string"), F.lit("(not summed)")))))
    found = found.union(totals.where("not ok").select(compare.alias("f")).select("f.*"))
    if not consistent:
        found = found.union(spark.createDataFrame([("BANK-PROFILE-INCONSISTENT", "warning", f"{control.amount} is not declared an amount; nothing is summed", None)], FINDING))
    return totals, found


@dataclass(frozen=True)
class BatchSpec:
    """Detail and trailer variants, the amount that is summed, and the trailer's count and total."""

    detail: str
    trailer: str
    amount: str
    trailer_count: str
    trailer_total: str


def batch_control(df: DataFrame, spec: VariantSpec, batch: BatchSpec, by: tuple[str, ...] = (), encoding: str = ASCII) -> DataFrame:
    """by, n_details, n_dirty, observed_total, declared_count, declared_total, ok for each batch; by are columns of df.

    Counts and sums compare as numbers. Amounts that aren't valid are counted, not dropped in silence. Partial aggregation
    leaves a row for each batch and task before the shuffle.
    """
    layout = {v.name: v.layout for v in spec.variants}
    d, t = layout[batch.detail], layout[batch.trailer]
    kind = spec.route()
    a, c, s = d.field(batch.amount), t.field(batch.trailer_count), t.field(batch.trailer_total)
    rows = df.select(*by, "record_index", kind.alias("kind"), valid(a, encoding).alias("ok"), number(a, encoding).alias("amount"), number(c, encoding).alias("count"), number(s, encoding).alias("total"))
    is_detail, is_trailer = F.col("kind") == batch.detail, F.col("kind") == batch.trailer
    last = lambda x: F.max_by(F.when(is_trailer, F.col(x)), F.when(is_trailer, F.col("record_index")))
    out = rows.groupBy(*by).agg(
        F.count_if(is_detail).alias("n_details"), F.count_if(is_detail & ~F.col("ok")).alias("n_dirty"), F.coalesce(F.sum(F.when(is_detail & F.col("ok"), F.col("amount"))), F.lit(Decimal(0))).cast(f"decimal(38,{a.pic.scale})").alias("observed_total"),
        last("count").cast("long").alias("declared_count"), last("total").alias("declared_total"),
    )
    ok = (F.col("n_dirty") == 0) & (F.col("n_details") == F.col("declared_count")) & (F.col("observed_total") == F.col("declared_total"))
    return out.withColumn("ok", F.coalesce(ok, F.lit(False)))
