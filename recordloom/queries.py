"""Registered queries of the core library: name -> (spark, sf_dir) -> DataFrame, and their SQL.

The tables are encoded to fixed records in flight and decoded again, so each query's SQL is plain SQL over the tables. All of
it is one plan of column expressions: scans read only the columns that a query uses.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.decode import CP500, condition, decode_long, number, raw_bytes, split_long_methods, typed
from recordloom.functions.encode import encode_record
from recordloom.operators import custody, profiles, recon, route, views
from recordloom.plans import pilot
from recordloom.plans.copybook import Layout, compile_layout
from recordloom.sources import fixedrec

ORDER = compile_layout("""
    01 ORDER-REC.
       05 O-KEY       PIC 9(10).
       05 O-STATUS    PIC X.
          88 IS-OPEN    VALUE "O".
          88 IS-FILLED  VALUE "F".
          88 IS-SETTLED VALUES ARE "F" "P".
       05 O-TOTAL     PIC S9(9)V99 COMP-3.
       05 O-DATE      PIC 9(8).
       05 O-CUST      PIC 9(9) COMP.
       05 O-DELTA     PIC S9(9) COMP-5.
       05 O-CODE      PIC 9(10) COMP-X.
       05 O-SERIAL    PIC 9(9) COMP-6.
       05 O-PRIORITY  PIC X(15).
""")
LINE = compile_layout("""
    01 LINE-REC.
       05 L-TYPE      PIC X.
       05 L-KEY       PIC 9(10).
       05 L-NO        PIC 9(3).
       05 L-QTY       PIC 9(5)V99 COMP-3.
       05 L-PRICE     PIC S9(9)V99 COMP-3.
       05 L-SHOWN     PIC ZZZ,ZZ9.99CR.
       05 L-FLAG      PIC X.
          88 RETURNED   VALUE "R".
""")
TRAILER = compile_layout("""
    01 TRAILER-REC.
       05 T-TYPE      PIC X.
       05 T-KEY       PIC 9(10).
       05 T-COUNT     PIC 9(9).
       05 T-DEBIT     PIC S9(13)V99 COMP-3.
       05 T-CREDIT    PIC S9(13)V99 COMP-3.
       05 FILLER      PIC X(7).
""")
CUSTOMER = compile_layout("""
    01 CUSTOMER-REC.
       05 C-KEY       PIC 9(9).
       05 C-NAME      PIC X(25).
       05 C-SEGMENT   PIC X(12).
       05 C-BALANCE   PIC S9(7)V99.
       05 C-OWED      PIC S9(7)V99 COMP-3.
       05 C-OWED-IND  PIC S9(4) COMP-5.
""")
PART = compile_layout("""
    01 PART-REC.
       05 P-KEY   PIC 9(9).
       05 P-SIZE  PIC 9(3).
          88 SMALL  VALUE 1 THRU 10.
          88 LARGE  VALUE 40 THROUGH 999.
""")
NATION = compile_layout("""
    01 NATION-REC.
       05 N-KEY     PIC 9(4).
       05 N-NAME    PIC X(15).
       05 N-REGION  PIC 9(2) COMP.
""")
SUPPLIER = compile_layout("""
    01 SUPPLIER-REC.
       05 S-KIND   PIC X.
       05 S-BODY   PIC X(20).
       05 S-SPLIT  REDEFINES S-BODY.
          10 S-HEAD  PIC X(8).
          10 S-TAIL  PIC X(12).
""")
EVENT = compile_layout("""
    01 EVENT-REC.
       05 E-SEQ    PIC 9(10).
       05 E-TXN    PIC X(12).
""")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return split_long_methods(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task encodes; a table of few rows isn't dealt out.
MOST_TASK_ROWS, LEAST_TASK_ROWS = 1_000_000, 10_000


def _tasks(table: DataFrame, most: int = MOST_TASK_ROWS) -> int:
    """Tasks for a table's rows, of which each takes at most about ``most``. The count reads the files' footers alone."""
    n = table.count()
    return max(n // most, min(n // LEAST_TASK_ROWS, 3 * table.sparkSession.sparkContext.defaultParallelism))


def _dealt(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """The table with its rows dealt out by their keys: a scan has no more tasks than the file has groups of rows, which can be one.

    What is made of a row costs many times what it takes to move it.
    """
    rows = _table(spark, sf_dir, name)
    tasks = _tasks(rows)
    return rows.repartition(tasks, *keys) if tasks > 1 else rows


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def _records(df: DataFrame, index: Column, layout: Layout, values: dict[str, Column], encoding: str = "ascii") -> DataFrame:
    return _once(df.select(index.cast("long").alias("record_index"), encode_record(layout, values, encoding).alias("record")))


def _once(df: DataFrame) -> DataFrame:
    """The records as if read: a projection above would copy their expression into each field that it decodes."""
    return df.select("record_index", F.explode(F.array("record")).alias("record"))


def _ymd(c: str) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("decimal(8,0)")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return _records(_dealt(spark, sf_dir, "orders", "o_orderkey"), key, ORDER, {
        "O-KEY": key, "O-STATUS": F.col("o_orderstatus"), "O-TOTAL": _money("o_totalprice"), "O-DATE": _ymd("o_orderdate"), "O-CUST": F.col("o_custkey"),
        "O-DELTA": F.col("o_custkey") - 500, "O-CODE": key * 7, "O-SERIAL": key % 1_000_000_000, "O-PRIORITY": F.col("o_orderpriority"),
    })


def lines(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """Detail records; an index of order and line number. With ``most``, in ranges of the index of about so many records each."""
    index = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = _table(spark, sf_dir, "lineitem")
    rows = rows.repartitionByRange(_tasks(rows, most) or 1, index) if most else _dealt(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    return _records(rows, index, LINE, {
        "L-TYPE": F.lit("D"), "L-KEY": F.col("l_orderkey"), "L-NO": F.col("l_linenumber"), "L-QTY": _money("l_quantity"), "L-PRICE": _money("l_extendedprice"), "L-SHOWN": _money("l_extendedprice"), "L-FLAG": F.col("l_returnflag"),
    })


def customers(spark: SparkSession, sf_dir: str, encoding: str = "ascii") -> DataFrame:
    owed = _money("c_acctbal")
    ind = F.when(owed < 0, -1).when(owed > 5000, 12).otherwise(0)
    return _records(_dealt(spark, sf_dir, "customer", "c_custkey"), F.col("c_custkey"), CUSTOMER, {
        "C-KEY": F.col("c_custkey"), "C-NAME": F.col("c_name"), "C-SEGMENT": F.col("c_mktsegment"), "C-BALANCE": owed, "C-OWED": owed, "C-OWED-IND": ind,
    }, encoding)


def _fields(df: DataFrame, layout: Layout, names: dict[str, str], encoding: str = "ascii", **cast: str) -> DataFrame:
    return df.select(*(typed(layout.field(f), encoding).cast(cast[k]).alias(k) if k in cast else typed(layout.field(f), encoding).alias(k) for k, f in names.items()))


def decode_display(spark, sf_dir):
    return _fields(orders(spark, sf_dir), ORDER, {"order_key": "O-KEY", "order_date": "O-DATE"}, order_key="long", order_date="long")


def decode_comp3(spark, sf_dir):
    return _fields(lines(spark, sf_dir), LINE, {"order_key": "L-KEY", "line_no": "L-NO", "quantity": "L-QTY", "price": "L-PRICE"}, order_key="long", line_no="long", quantity="decimal(18,2)", price="decimal(18,2)")


def decode_comp(spark, sf_dir):
    return _fields(orders(spark, sf_dir), ORDER, {"order_key": "O-KEY", "cust": "O-CUST"}, order_key="long", cust="long")


def decode_comp5(spark, sf_dir):
    return _fields(orders(spark, sf_dir), ORDER, {"order_key": "O-KEY", "delta": "O-DELTA"}, order_key="long", delta="long")


def decode_compx(spark, sf_dir):
    return _fields(orders(spark, sf_dir), ORDER, {"order_key": "O-KEY", "code": "O-CODE"}, order_key="long", code="long")


def decode_comp6(spark, sf_dir):
    return _fields(orders(spark, sf_dir), ORDER, {"order_key": "O-KEY", "serial": "O-SERIAL"}, order_key="long", serial="long")


def decode_cp500_text(spark, sf_dir):
    return _fields(customers(spark, sf_dir, CP500), CUSTOMER, {"cust_key": "C-KEY", "name": "C-NAME", "segment": "C-SEGMENT"}, CP500, cust_key="long")


def decode_cp500_zoned(spark, sf_dir):
    return _fields(customers(spark, sf_dir, CP500), CUSTOMER, {"cust_key": "C-KEY", "balance": "C-BALANCE", "owed": "C-OWED"}, CP500, cust_key="long", balance="decimal(18,2)", owed="decimal(18,2)")


def decode_edited(spark, sf_dir):
    from recordloom.functions.decode import value

    f = LINE.field("L-SHOWN")
    return lines(spark, sf_dir).select("record_index", value(f).alias("shown"), number(f).cast("decimal(18,2)").alias("amount"))


def conditions_88(spark, sf_dir):
    by = {c.name: c for c in ORDER.conditions}
    return orders(spark, sf_dir).select("record_index", *(condition(by[n], ORDER).alias(k) for k, n in (("is_open", "IS-OPEN"), ("is_filled", "IS-FILLED"), ("is_settled", "IS-SETTLED"))))


def conditions_range(spark, sf_dir):
    p = _records(_table(spark, sf_dir, "part"), F.col("p_partkey"), PART, {"P-KEY": F.col("p_partkey"), "P-SIZE": F.col("p_size")})
    by = {c.name: c for c in PART.conditions}
    return p.select("record_index", condition(by["SMALL"], PART).alias("small"), condition(by["LARGE"], PART).alias("large"))


def control_totals(spark, sf_dir):
    return recon.control_totals(lines(spark, sf_dir), LINE).where(F.col("kind").isin("records", "sum", "condition"))


def _dirty(spark, sf_dir):
    """The detail records, with a bad sign nibble in the price of each 97th order."""
    f = LINE.field("L-PRICE")
    bad = F.concat(F.substring("record", 1, f.offset), F.lit(bytes([0x12] * f.size)), F.expr(f"substring(record, {f.offset + f.size + 1})"))
    return _once(lines(spark, sf_dir).withColumn("record", F.when(F.floor(F.col("record_index") / 10) % 97 == 0, bad).otherwise(F.col("record"))))


def dirty_evidence(spark, sf_dir):
    return recon.dirty_fields(_dirty(spark, sf_dir), LINE).select("record_index", F.array_join("invalid", ",").alias("invalid")).where("invalid <> ''")


def dirty_totals(spark, sf_dir):
    return recon.control_totals(_dirty(spark, sf_dir), LINE).where("name = 'L-PRICE'")


def _nations(spark, sf_dir):
    return _records(_table(spark, sf_dir, "nation"), F.col("n_nationkey"), NATION, {"N-KEY": F.col("n_nationkey"), "N-NAME": F.col("n_name"), "N-REGION": F.col("n_regionkey")})


def explain_long(spark, sf_dir):
    return decode_long(_nations(spark, sf_dir), NATION).select("record_index", "name", "value", "raw_hex")


def explain_one(spark, sf_dir):
    return recon.explain_field(_nations(spark, sf_dir), NATION, "N-NAME", 7).select("record_index", "name", "offset", "size", "value", "valid", "raw_sha256")


def _headers(spark, sf_dir):
    """Order records as type H, cut to the length of a detail record."""
    length = LINE.record_len
    return _once(orders(spark, sf_dir).select((F.col("record_index") * 10).alias("record_index"), F.substring(F.concat(F.lit(b"H"), F.col("record")), 1, length).alias("record")))


def _variants() -> route.VariantSpec:
    return route.VariantSpec(0, 1, (route.Variant("detail", b"D", LINE), route.Variant("trailer", b"T", TRAILER), route.Variant("void", b"V", TRAILER)))


def variant_route(spark, sf_dir):
    rows = route.variant_route(_headers(spark, sf_dir).union(lines(spark, sf_dir)), _variants())
    return rows.select("record_index", F.coalesce("variant", F.lit("(unknown)")).alias("variant"), "disc_hex", "disc_text")


def variant_counts(spark, sf_dir):
    return route.variant_counts(_headers(spark, sf_dir).union(lines(spark, sf_dir)), _variants())


CONTROL = route.Control("detail", "trailer", "L-PRICE", "L-FLAG", ("R", "A"), ("N",), "T-COUNT", "T-DEBIT", "T-CREDIT", {"L-PRICE": "amount", "L-QTY": "quantity", "L-KEY": "identifier"})


def _with_trailer(spark, sf_dir, off: str = "0"):
    t = _table(spark, sf_dir, "lineitem")
    paid = F.col("l_returnflag").isin("R", "A")
    price = _money("l_extendedprice")
    sums = t.agg(F.count("*").alias("n"), F.sum(F.when(paid, price)).alias("d"), F.sum(F.when(~paid, price)).alias("c"))
    trailer = _records(sums, F.lit(2**60), TRAILER, {"T-TYPE": F.lit("T"), "T-KEY": F.lit(0), "T-COUNT": F.col("n"), "T-DEBIT": F.col("d") + F.lit(Decimal(off)), "T-CREDIT": F.col("c"), "FILLER": F.lit("")})
    return lines(spark, sf_dir).union(trailer)


def banking_reconcile(spark, sf_dir):
    return route.reconcile_banking(_with_trailer(spark, sf_dir), _variants(), CONTROL)[0]


def banking_tampered(spark, sf_dir):
    return route.reconcile_banking(_with_trailer(spark, sf_dir, "0.01"), _variants(), CONTROL)[1].select("rule_id", "message")


def batch_control(spark, sf_dir):
    """A batch an order; the trailer of each 50th declares one line too many."""
    t = _table(spark, sf_dir, "lineitem")
    sums = t.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(_money("l_extendedprice")).alias("d"))
    trailer = _records(sums, F.col("l_orderkey") * 10 + 9, TRAILER, {"T-TYPE": F.lit("T"), "T-KEY": F.col("l_orderkey"), "T-COUNT": F.col("n") + (F.col("l_orderkey") % 50 == 0).cast("int"), "T-DEBIT": F.col("d"), "T-CREDIT": F.lit(0), "FILLER": F.lit("")})
    rows = lines(spark, sf_dir).union(trailer).withColumn("batch", F.decode(F.substring("record", 2, 10), "US-ASCII").cast("long"))
    out = route.batch_control(rows, _variants(), route.BatchSpec("detail", "trailer", "L-PRICE", "T-COUNT", "T-DEBIT"), by=("batch",))
    return out.select("batch", "n_details", F.col("observed_total").cast("decimal(18,2)").alias("observed_total"), "declared_count", "ok")


def record_hash(spark, sf_dir):
    return _nations(spark, sf_dir).select("record_index", F.sha2("record", 256).alias("record_sha256"))


def _events(spark, sf_dir):
    """Sequences with holes and repeats, and repeated transaction ids."""
    e = F.col("event_id")
    seq = F.when((e % 101 == 0) & (e > 0), e - 1).otherwise(e)
    return _records(_table(spark, sf_dir, "events"), e, EVENT, {"E-SEQ": seq, "E-TXN": F.concat(F.lit("T"), (e - F.when(e % 250 == 7, 5).otherwise(0)).cast("string"))})


def _event_values(spark, sf_dir):
    return _fields(_events(spark, sf_dir), EVENT, {"seq": "E-SEQ"}, seq="long")


def posting_sequence_dups(spark, sf_dir):
    return custody.sequence_duplicates(_event_values(spark, sf_dir), "seq")


def posting_sequence_gaps(spark, sf_dir):
    return custody.sequence_gaps(_event_values(spark, sf_dir), "seq")


def posting_txn_dups(spark, sf_dir):
    rows = _events(spark, sf_dir).select("record_index", typed(EVENT.field("E-TXN")).alias("txn"))
    return custody.repeated_ids(rows, "txn")


def posting_chain(spark, sf_dir):
    return custody.record_chain(_nations(spark, sf_dir))


def _batches(spark, sf_dir):
    r = _table(spark, sf_dir, "region")
    h = lambda p: F.sha2(F.concat(F.lit(p), F.col("r_name")), 256)
    return r.select(F.col("r_regionkey").cast("long").alias("batch_no"), F.col("r_name").alias("batch_id"), h("in:").alias("input_hash"), h("ctl:").alias("control_hash"), h("out:").alias("output_hash"))


def batch_chain(spark, sf_dir):
    return custody.seal_chain(_batches(spark, sf_dir)).select("batch_no", "prev_hash", "link_hash")


def batch_chain_verify(spark, sf_dir):
    sealed = custody.seal_chain(_batches(spark, sf_dir))
    return custody.verify_chain(sealed.withColumn("output_hash", F.when(F.col("batch_no") == 2, F.lit("tampered")).otherwise(F.col("output_hash"))))


def db2_indicators(spark, sf_dir):
    rows = profiles.null_indicators(customers(spark, sf_dir), CUSTOMER, (profiles.Indicator("C-OWED", "C-OWED-IND"),))
    return rows.select("record_index", "status", "value", "original_length")


def sentinel_scan(spark, sf_dir):
    rules = (profiles.Sentinel("O-STATUS", "still open", value="O"), profiles.Sentinel("O-DATE", "day of note", raw_hex=b"19950101".hex()))
    return profiles.sentinel_scan(orders(spark, sf_dir), ORDER, rules).select("record_index", "field", "meaning", "value")


def date_validate(spark, sf_dir):
    """Order dates as they are, but for a day 32 in each 13th, and zeros, a declared sentinel, in each 17th."""
    t = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    text = F.when(key % 17 == 0, F.lit("00000000")).when(key % 13 == 0, F.concat(F.date_format("o_orderdate", "yyyyMM"), F.lit("32"))).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    layout = compile_layout("01 D.\n 05 D-DATE PIC 9(8).\n")
    rows = t.select(key.alias("record_index"), F.encode(text, "US-ASCII").alias("record"))
    return profiles.date_validate(rows, layout, (profiles.DateRule("D-DATE", sentinels=("00000000",)),)).select("record_index", "text", "status")


def currency_scale(spark, sf_dir):
    rules = (profiles.CurrencyRule("O-TOTAL", "amount", 2, "O-PRIORITY"), profiles.CurrencyRule("O-TOTAL", "amount", 3), profiles.CurrencyRule("O-CUST", "identifier", 0))
    rows = profiles.currency_validate(orders(spark, sf_dir), ORDER, rules)
    return rows.select("record_index", "field", "value", F.array_join("rule_ids", ",").alias("rule_ids"), "admitted_as_money")


def redefines_views(spark, sf_dir):
    t = _table(spark, sf_dir, "supplier")
    kind = F.when(F.col("s_suppkey") % 2 == 0, "S").otherwise("B")
    rows = _records(t, F.col("s_suppkey"), SUPPLIER, {"S-KIND": kind, "S-BODY": F.col("s_name")})
    return profiles.redefines_manifest(rows, SUPPLIER, "S-BODY", "S-KIND", {"S": "S-SPLIT", "B": "S-BODY"})


REDACTION = profiles.Redaction("pilot", {"C-KEY": "allow", "C-NAME": "token", "C-SEGMENT": "hash"})


def redact_tokens(spark, sf_dir):
    return profiles.redact(customers(spark, sf_dir), CUSTOMER, REDACTION).where("action = 'token'").select("record_index", "field", "value")


def redact_hashes(spark, sf_dir):
    return profiles.redact(customers(spark, sf_dir), CUSTOMER, REDACTION).where("action <> 'token'").select("record_index", "field", "action", "value", "value_sha256", F.coalesce("rule_id", F.lit("")).alias("rule_id"))


def _shifted(spark, sf_dir):
    """Customers but for each 11th, with another segment in each 7th."""
    c = customers(spark, sf_dir)
    f = CUSTOMER.field("C-SEGMENT")
    other = F.concat(F.substring("record", 1, f.offset), F.lit(b"ELSEWHERE   "), F.expr(f"substring(record, {f.offset + f.size + 1})"))
    return _once(c.where("record_index % 11 <> 0").withColumn("record", F.when(F.col("record_index") % 7 == 0, other).otherwise(F.col("record"))))


def diff_fields(spark, sf_dir):
    a = decode_long(customers(spark, sf_dir), CUSTOMER).where("name = 'C-SEGMENT'")
    b = decode_long(_shifted(spark, sf_dir), CUSTOMER).where("name = 'C-SEGMENT'")
    return views.diff_fields(a, b)


def diff_totals(spark, sf_dir):
    a, b = recon.control_totals(customers(spark, sf_dir), CUSTOMER), recon.control_totals(_shifted(spark, sf_dir), CUSTOMER)
    return views.diff_totals(a, b).where("kind in ('records', 'sum')")


def transform_add(spark, sf_dir):
    out, _ = recon.transform(orders(spark, sf_dir), ORDER, recon.Transform("add", "O-TOTAL", "12.345"))
    after = out.select("record_index", F.col("after").alias("record"), "changed")
    return after.select("record_index", number(ORDER.field("O-TOTAL")).cast("decimal(18,2)").alias("total"), "changed")


def transform_set_true(spark, sf_dir):
    out, _ = recon.transform(orders(spark, sf_dir), ORDER, recon.Transform("set_true", "IS-SETTLED"))
    after = out.select("record_index", F.col("after").alias("record"), "changed")
    return after.select("record_index", typed(ORDER.field("O-STATUS")).alias("status"), "changed")


def transform_delta(spark, sf_dir):
    out, _ = recon.transform(orders(spark, sf_dir), ORDER, recon.Transform("set_true", "IS-OPEN"))
    return recon.transform_delta(out, ORDER)


def status_totals(spark, sf_dir):
    """Count and exact sum by status: decode and one aggregation."""
    rows = _fields(orders(spark, sf_dir), ORDER, {"status": "O-STATUS", "total": "O-TOTAL"})
    return rows.groupBy("status").agg(F.count("*").alias("orders"), F.sum("total").cast("decimal(18,2)").alias("total"))


def raw_slices(spark, sf_dir):
    f = NATION.field("N-NAME")
    return _nations(spark, sf_dir).select("record_index", F.lower(F.hex(raw_bytes(f))).alias("raw_hex"), F.length("record").cast("long").alias("record_len"))


def posting_findings(spark, sf_dir):
    spec = custody.PostingSpec("unit-1", "E-SEQ", "E-TXN", contiguous=True)
    return custody.posting_findings(_events(spark, sf_dir), EVENT, spec).groupBy("rule_id").agg(F.count("*").alias("n"))


def record_lines(spark, sf_dir):
    rows = _nations(spark, sf_dir).withColumn("raw_offset", F.col("record_index") * NATION.record_len).withColumn("raw_len", F.length("record"))
    return recon.record_json(rows, NATION).select("record_index", "line")


def field_map(spark, sf_dir):
    return views.field_map(customers(spark, sf_dir), CUSTOMER, REDACTION).select("record_index", "field", "offset", "size", "action", "value_sha256")


def fixture_replay(spark, sf_dir):
    found = route.reconcile_banking(_with_trailer(spark, sf_dir, "0.01"), _variants(), CONTROL)[1]
    return views.replay_fixture(views.Fixture("tampered", "mismatch", frozenset({"BANK-NO-TRAILER"})), "pass", found)


def _in_file(df: DataFrame, label: str, files: int = 1) -> str:
    """The records in a folder of so many files; its path."""
    folder = fixedrec.new_folder(df.sparkSession, label)
    fixedrec.write_records(df, folder, files)
    return folder


def ingest_records(spark, sf_dir):
    """Orders written to eight files, read by the source in ranges and decoded; records are numbered through the files."""
    rows = fixedrec.read_records(spark, _in_file(orders(spark, sf_dir), "orders", 8), fixedrec.Policy(ORDER.record_len), split_bytes=100 * ORDER.record_len)
    return rows.select("record_index", typed(ORDER.field("O-KEY")).cast("long").alias("order_key"), typed(ORDER.field("O-TOTAL")).cast("decimal(18,2)").alias("total"), typed(ORDER.field("O-STATUS")).alias("status"))


def ingest_nth(spark, sf_dir):
    """One record by its number; the source reads the bytes of this record alone."""
    rows = fixedrec.nth_record(spark, _in_file(_nations(spark, sf_dir), "nations", 3), fixedrec.Policy(NATION.record_len), 11)
    return rows.select("record_index", "raw_len", "partial", typed(NATION.field("N-NAME")).alias("name"))


def _nation_file(spark, sf_dir, end: bytes = b"") -> str:
    rows = _nations(spark, sf_dir)
    last = spark.createDataFrame([(10**9, end)], "record_index long, record binary") if end else rows.limit(0)
    folder = _in_file(rows.union(last), "nation")
    return fixedrec.files_of(folder)[0]


def ingest_spans(spark, sf_dir):
    """A file whose last record is cut: the piece is kept as evidence."""
    rows = fixedrec.read_records(spark, _nation_file(spark, sf_dir, b"0099CUT"), fixedrec.Policy(NATION.record_len, partial="evidence"), split_bytes=4 * NATION.record_len)
    return rows.select("record_index", "raw_offset", "raw_len", "partial", F.sha2("record", 256).alias("record_sha256"))


#: What a file ends with beyond its records, and the policy: strict, line ends and partial records, each way.
_INGEST_CASES = (("clean", b"", {}), ("line-feed-reject", b"\n", {}), ("line-feed-allow", b"\n", {"newline": "allow"}), ("line-feed-strip", b"\n", {"newline": "strip"}), ("partial-reject", b"0099CUT", {}), ("partial-evidence", b"0099CUT", {"partial": "evidence"}))


def ingest_manifest(spark, sf_dir):
    """A manifest for each policy and file end; refused files have an exit code and no records."""
    out, paths = None, {end: _nation_file(spark, sf_dir, end) for end in {c[1] for c in _INGEST_CASES}}
    for name, end, policy in _INGEST_CASES:
        row = fixedrec.file_manifest(spark, paths[end], fixedrec.Policy(NATION.record_len, **policy)).select(F.lit(name).alias("case"), "sha256", "file_bytes", "record_count", "first_offset", "last_offset", "partial", "stripped_line_feed", "exit_code")
        out = row if out is None else out.union(row)
    return out


def reconcile_receipt(spark, sf_dir):
    """The audit receipt of a file of records."""
    rows = fixedrec.read_records(spark, _nation_file(spark, sf_dir), fixedrec.Policy(NATION.record_len))
    return recon.reconcile(rows, NATION, "nation").receipt.select("fixture", "copybook_sha256", "record_count", "field_count", "condition_count", "unsupported_count", "decode_output_sha256", "has_binary", "has_comp6")


ODD = compile_layout("""
    01 ODD-REC.
       05 X-KEY    PIC 9(4).
          88 X-EVEN  VALUE 0 2 4 6 8.
       05 X-BAD    PIC 9(4) COMP-1.
       05 X-NAME   PIC X(11).
       05 X-FLAG   PIC 9(2).
          88 X-ON    VALUE 1.
""")


def reconcile_ledger(spark, sf_dir):
    """Unsupported storage, and a condition whose field the record is too short for: by item, and as the first record has it."""
    rows = _nations(spark, sf_dir).withColumns({"record": F.substring("record", 1, ODD.record_len - 2), "raw_offset": F.col("record_index") * 20, "raw_len": F.lit(ODD.record_len - 2)})
    made = recon.reconcile(rows, ODD, "odd")
    return made.ledger.select(F.col("item").alias("unsupported"), F.col("records").alias("n")).union(made.summary.select(F.concat(F.lit("all: "), F.array_join("unsupported", ",")), "unsupported_count"))


def strict_decode(spark, sf_dir):
    return recon.strict_decode(_nations(spark, sf_dir), NATION).select(typed(NATION.field("N-KEY")).cast("long").alias("key"), typed(NATION.field("N-NAME")).alias("name"))


def posting_manifest(spark, sf_dir):
    out = custody.posting_manifest(_nations(spark, sf_dir), NATION, custody.PostingSpec("unit-1", "N-KEY", "N-NAME", contiguous=True))
    return out.select("unit_id", "records", "last_hash", F.col("first_seq").cast("long").alias("first_seq"), F.col("last_seq").cast("long").alias("last_seq"), "findings")


def extract_manifest(spark, sf_dir):
    out = profiles.extract_manifest(_nations(spark, sf_dir), NATION, "unit-1", {"source": "nation"})
    return out.select("unit", F.col("declared")["source"].alias("source"), "records", "chain_sha256", "copybook_sha256")


def chain_by_ranges(spark, sf_dir):
    """The record chain with at most seven records to a task: ranges are ordered apart and hashed one after the other."""
    return custody.record_chain(_nations(spark, sf_dir), most=7)


def order_chains(spark, sf_dir):
    """A record chain for each order over its lines, whose bytes are made by hand."""
    key, no = F.col("l_orderkey"), F.col("l_linenumber")
    text = F.concat(F.lpad(key.cast("string"), 10, "0"), F.lpad(no.cast("string"), 3, "0"), F.col("l_returnflag"))
    rows = _table(spark, sf_dir, "lineitem").select(key.alias("unit"), no.alias("record_index"), F.encode(text, "US-ASCII").alias("record"))
    return custody.unit_chains(rows, "unit")


def bank_report(spark, sf_dir):
    """The operator's report as JSON and as text."""
    totals, found = route.reconcile_banking(_with_trailer(spark, sf_dir), _variants(), CONTROL)
    made = views.reconcile_report(totals, found, {"unit": "unit-1"})
    return spark.createDataFrame([(k, made[k]) for k in ("json", "markdown")], "format string, text string")


def _pilot_unit(spark, sf_dir):
    """Customers as a unit of the workflow: what they owe are debits, what they are owed credits; the trailer balances them."""
    c = _table(spark, sf_dir, "customer")
    owed, paid = F.abs(_money("c_acctbal")), _money("c_acctbal") < 0
    details = _records(c, F.col("c_custkey"), pilot.DETAIL, {"REC-TYPE": F.lit("D"), "DR-CR-IND": F.when(paid, "C").otherwise("D"), "ACCT-ID": F.concat(F.lit("K"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")), "AMOUNT": owed, "FILLER": F.lit("")})
    zero = F.lit(Decimal("0.00"))
    sums = c.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(~paid, owed)), zero).alias("d"), F.coalesce(F.sum(F.when(paid, owed)), zero).alias("c"))
    return details.union(_records(sums, F.lit(2**60), pilot.TRAILER, {"REC-TYPE": F.lit("T"), "TRL-COUNT": F.col("n"), "TRL-DEBIT": F.col("d"), "TRL-CREDIT": F.col("c"), "FILLER": F.lit("")}))


def pilot_redaction(spark, sf_dir):
    """The redacted fields of all customers, after the whole workflow and its leak check."""
    made = pilot.run_pilot(_pilot_unit(spark, sf_dir), pilot.sample_pilot("unit-1"))
    return made.rows["redaction"].where("field <> 'FILLER'").select("record_index", "field", "action", "redacted", "value", "value_sha256")


def pilot_packet(spark, sf_dir):
    """The packet of the same workflow: its checklist, its notes, and the pins of its row artifacts over all customers."""
    made = pilot.run_pilot(_pilot_unit(spark, sf_dir), pilot.sample_pilot("unit-1", "notes"))
    packet = json.loads(made.texts["packet"])
    rows = [("notes", packet["notes_sha256"]), ("complete", str(packet["complete"]).lower())] + [(f["rule_id"], f["detail"]) for f in packet["findings"]] + [("done " + c["item"], str(c["done"]).lower()) for c in packet["checklist"]]
    rows += [("rows " + k, str(v["records"])) for k, v in packet["rows"].items()] + [("redaction sha256", packet["rows"]["redaction"]["hash"])]
    rows += [("pin " + k, v) for k, v in packet["artifacts"].items() if k == "redaction"]
    return spark.createDataFrame(rows, "item string, text string")


PRICE = compile_layout("""
    01 PRICE-REC.
       05 P-AMT   PIC S9(9)V99 COMP-3.
       05 P-RATE  PIC 9(2)V999.
       05 P-CODE  PIC X(3).
""")


def _prices(spark, sf_dir):
    """Bytes made by hand: the price's digits and a sign as nibbles, then text."""
    packed = F.unhex(F.concat(F.lpad((_money("o_totalprice") * 100).cast("long").cast("string"), 11, "0"), F.lit("C")))
    return _once(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_index"), F.concat(packed, F.lit(b"12345USD")).alias("record")))


def currency_rules(spark, sf_dir):
    """Several findings in one row, the scale of the value itself, and a mismatch that is declared to be none."""
    C = profiles.CurrencyRule
    rules = (C("P-AMT", "amount", 2, "P-CODE"), C("P-AMT", "amount", 3, "P-NONE"), C("P-AMT", "amount", 3, scale_is_finding=False), C("P-RATE", "rate", 2), C("P-GONE", "amount", 2))
    rows = profiles.currency_validate(_prices(spark, sf_dir), PRICE, rules)
    return rows.select("record_index", "field", "value", "observed_scale", "code", F.array_join("rule_ids", ",").alias("rule_ids"))


def redact_published(spark, sf_dir):
    """The published rule: raw bytes stay where a value is only hashed, also for fields that aren't listed."""
    rule = profiles.Redaction("pilot", {"P-CODE": "hash_only", "P-RATE": "token"}, keep_raw=True)
    rows = profiles.redact(_prices(spark, sf_dir), PRICE, rule)
    return rows.withColumn("rule_id", F.coalesce("rule_id", F.lit("")))


DATES = compile_layout("""
    01 DATE-REC.
       05 D-DAY   PIC 9(8).
       05 D-JUL   PIC 9(5).
       05 D-PACK  PIC 9(8) COMP-3.
""")


def date_findings(spark, sf_dir):
    """Zeros that no sentinel declares, days 366 of common years, and packed bytes, which hold no digits of text."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    text = F.concat(F.when(key % 17 == 0, F.lit("00000000")).otherwise(day), F.when(key % 5 == 0, F.lit("23366")).otherwise(F.lit("24366")))
    packed = F.unhex(F.concat(F.lit("0"), day, F.lit("C")))
    rows = _once(_table(spark, sf_dir, "orders").select(key.alias("record_index"), F.concat(F.encode(text, "US-ASCII"), packed).alias("record")))
    D = profiles.DateRule
    found = profiles.date_findings(profiles.date_validate(rows, DATES, (D("D-DAY", require_sentinel=True), D("D-JUL", "YYDDD"), D("D-PACK"), D("D-NONE"))))
    return found.groupBy("rule_id", "message").agg(F.count("*").alias("n"))


MILLS = compile_layout("01 M-REC.\n 05 M-TYPE PIC X.\n 05 M-FLAG PIC X.\n 05 M-AMT PIC 9(9)V999.\n")
MILLS_END = compile_layout("01 E-REC.\n 05 E-TYPE PIC X.\n 05 E-COUNT PIC 9(9)V9.\n 05 E-DEBIT PIC 9(9)V999.\n 05 E-CREDIT PIC 9(9)V99.\n")


def banking_decimals(spark, sf_dir):
    """Amounts of three decimals are dirty, not rounded; a count with a decimal and a total of three declare nothing."""
    digits = F.lpad((_money("l_extendedprice") * 1000).cast("long").cast("string"), 12, "0")
    index = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = _table(spark, sf_dir, "lineitem").select(index.alias("record_index"), F.encode(F.concat(F.lit("D"), F.col("l_returnflag"), digits), "US-ASCII").alias("record"))
    end = spark.createDataFrame([(2**60, b"T" + b"0000000031" + b"000000000000" + b"00000000000")], "record_index long, record binary")
    spec = route.VariantSpec(0, 1, (route.Variant("detail", b"D", MILLS), route.Variant("trailer", b"T", MILLS_END)))
    control = route.Control("detail", "trailer", "M-AMT", "M-FLAG", ("R", "A"), ("N",), "E-COUNT", "E-DEBIT", "E-CREDIT", {"M-AMT": "amount"})
    totals, found = route.reconcile_banking(_once(rows.union(end)), spec, control)
    counts = found.groupBy("rule_id").agg(F.count("*").cast("decimal(38,2)").alias("n"))
    return counts.union(totals.select(F.concat(F.lit("observed "), "measure"), "observed"))


def banking_inconsistent(spark, sf_dir):
    """A profile that doesn't call the summed field an amount: the finding is told and nothing is summed."""
    control = replace(CONTROL, roles={"L-PRICE": "rate"})
    totals, found = route.reconcile_banking(_with_trailer(spark, sf_dir), _variants(), control)
    return found.select("rule_id", "message").union(totals.select("measure", F.coalesce(F.col("observed").cast("string"), F.lit("(not summed)"))))


def diff_note(spark, sf_dir):
    """Equal artifacts against targets of different standing; dimensions that aren't allowed; a hash that one side lacks."""
    t = recon.control_totals(_nations(spark, sf_dir), NATION)
    one, other = decode_long(_nations(spark, sf_dir), NATION), decode_long(_nations(spark, sf_dir).where("record_index <> 3"), NATION)
    A, T = views.Artifacts, views.Target
    cases = {
        "equal, no oracle": (A(totals=t), A(totals=t), T()), "equal, oracle": (A(totals=t), A(totals=t), T(views.ORACLE)),
        "fields not allowed": (A(fields=one, totals=t), A(fields=other, totals=t), T("declared_baseline", ("control_totals",))),
        "fields allowed": (A(fields=one), A(fields=other), T()), "one hash": (A(totals=t, hashes={"out": "1"}), A(totals=t), T(views.ORACLE)),
    }
    out = None
    for name, (a, b, target) in cases.items():
        rows = views.diff_artifacts(a, b, target).select(F.lit(name).alias("case"), "rule_id", "detail")
        out = rows if out is None else out.union(rows)
    return out


def json_dialects(spark, sf_dir):
    """Control characters in both dialects of escapes."""
    text = F.concat(F.col("r_name"), *(F.lit(x) for x in ("\b", "\f", "\n", "\t", "\x0b", "\x1f", "\\b", '"')))
    line = F.to_json(F.struct(text.alias("v")))
    return _table(spark, sf_dir, "region").select("r_regionkey", recon.json_escapes(line).alias("short"), recon.json_escapes(line, short=False).alias("long"))


QUERIES = {f.__name__: f for f in (
    decode_display, decode_comp3, decode_comp, decode_comp5, decode_compx, decode_comp6, decode_cp500_text, decode_cp500_zoned, decode_edited, conditions_88, conditions_range, control_totals, dirty_evidence,
    dirty_totals, explain_long, explain_one, variant_route, variant_counts, banking_reconcile, banking_tampered, batch_control, record_hash, posting_sequence_dups, posting_sequence_gaps, posting_txn_dups, posting_chain,
    batch_chain, batch_chain_verify, db2_indicators, sentinel_scan, date_validate, currency_scale, redefines_views, redact_tokens, redact_hashes, diff_fields, diff_totals, transform_add, transform_set_true, transform_delta,
    status_totals, raw_slices, posting_findings, record_lines, field_map, fixture_replay, ingest_records, ingest_nth, ingest_spans, ingest_manifest, reconcile_receipt, reconcile_ledger, strict_decode, posting_manifest,
    extract_manifest, chain_by_ranges, order_chains, bank_report, pilot_redaction, pilot_packet, currency_rules, redact_published, date_findings, banking_decimals, banking_inconsistent, diff_note, json_dialects,
)}

_PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"
_TOTAL = "CAST(o_totalprice AS DECIMAL(18,2))"
_BAL = "CAST(c_acctbal AS DECIMAL(18,2))"
_INDEX = "l_orderkey * 10 + l_linenumber"
_DATE = "strftime(o_orderdate, '%Y%m%d')"
_NATION_HEX = "lower(hex(encode(lpad(n_nationkey::VARCHAR, 4, '0') || rpad(n_name, 15, ' ')))) || lpad(lower(to_hex(n_regionkey)), 2, '0')"
_NATION_SHA = f"sha256(unhex({_NATION_HEX}))"
_PAID = "l_returnflag IN ('R', 'A')"
_SEQ = "SELECT event_id AS e, CASE WHEN event_id % 101 = 0 AND event_id > 0 THEN event_id - 1 ELSE event_id END AS seq FROM events"
_TXN = '''SELECT event_id AS "at", 'T' || (event_id - CASE WHEN event_id % 250 = 7 THEN 5 ELSE 0 END) AS value FROM events'''
_DUPS = f"SELECT seq AS value, count(*) AS times FROM ({_SEQ}) GROUP BY seq HAVING count(*) > 1"
_GAPS = f'SELECT v + 1 AS "first", n - 1 AS "last" FROM (SELECT seq AS v, lead(seq) OVER (ORDER BY seq) AS n FROM (SELECT DISTINCT seq FROM ({_SEQ}))) WHERE n > v + 1'
_AGAIN = f'''SELECT value, "at" FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY "at") AS n FROM ({_TXN})) WHERE n = 2'''
_SEG = "SELECT c_custkey AS k, c_mktsegment AS s FROM customer"
_SHIFTED = "SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'ELSEWHERE' ELSE c_mktsegment END AS s FROM customer WHERE c_custkey % 11 <> 0"
_SEALS = "SELECT r_regionkey AS no, r_name AS id, sha256('in:' || r_name) AS i, sha256('ctl:' || r_name) AS c, sha256('out:' || r_name) AS o FROM region"
_LINKS = f"""WITH RECURSIVE b AS ({_SEALS}), c AS (
  SELECT no, '' AS prev_hash, sha256(id || chr(30) || i || chr(30) || c || chr(30) || o || chr(30)) AS link_hash FROM b WHERE no = 0
  UNION ALL SELECT b.no, c.link_hash, sha256(b.id || chr(30) || b.i || chr(30) || b.c || chr(30) || b.o || chr(30) || c.link_hash) FROM b JOIN c ON b.no = c.no + 1)"""
_NATION_HEXES = f"(SELECT string_agg({_NATION_HEX}, '' ORDER BY n_nationkey) FROM nation)"
_NATION_CHAIN = f"""WITH RECURSIVE r AS (SELECT n_nationkey AS k, {_NATION_HEX} AS x FROM nation), c AS (SELECT k, sha256(unhex(x)) AS h FROM r WHERE k = 0 UNION ALL SELECT r.k, sha256(unhex(hex(encode(c.h)) || r.x)) FROM r JOIN c ON r.k = c.k + 1)"""
_LINE = f"""'{{"record_index":' || n_nationkey || ',"fields":{{"N-KEY":"' || n_nationkey || '","N-NAME":"' || n_name || '","N-REGION":"' || n_regionkey || '"}},"conditions":{{}},"audit":{{"raw_offset":' || n_nationkey * 20 || ',"raw_len":20,"record_sha256":"' || {_NATION_SHA} || '"}}}}'"""
_CENTS = f"lpad(({_TOTAL} * 100)::BIGINT::VARCHAR, 11, '0')"
_OWED_IND = f"(CASE WHEN {_BAL} < 0 THEN -1 WHEN {_BAL} > 5000 THEN 12 ELSE 0 END)::VARCHAR"


_PILOT = f"SELECT c_custkey AS k, CASE WHEN {_BAL} < 0 THEN 'C' ELSE 'D' END AS p, 'K' || lpad(c_custkey::VARCHAR, 7, '0') AS a, abs({_BAL})::VARCHAR AS m FROM customer"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _manifest(case: str, tail: str, length: int, records: int, code: int, partial: bool = False, stripped: bool = False) -> str:
    """A file of 25 records of 20 bytes and the tail, as hex."""
    return f"SELECT '{case}' AS \"case\", sha256(unhex({_NATION_HEXES} || '{tail}')) AS sha256, {500 + length}::BIGINT AS file_bytes, {records}::BIGINT AS record_count, {0 if records else -1}::BIGINT AS first_offset, {(records - 1) * 20 if records else -1}::BIGINT AS last_offset, {str(partial).lower()} AS partial, {str(stripped).lower()} AS stripped_line_feed, {code} AS exit_code"


def _packet() -> str:
    """The lines of the redaction as JSON, their digest, and what the packet says of it."""
    shown = lambda field, value, raw: f"""SELECT k, '{field}' AS field, '{{"record_index":' || k || ',"field":"{field}","action":"allow","redacted":false,"value":"' || {value} || '","value_sha256":"' || sha256({value}) || '","raw_sha256":"' || sha256(unhex({raw})) || '","raw_hex":"' || {raw} || '"}}' AS line FROM d"""
    token = """SELECT k, 'ACCT-ID' AS field, '{"record_index":' || k || ',"field":"ACCT-ID","action":"token","redacted":true,"value":"TOK-' || sha256('pilot:' || a)[1:12] || '","value_sha256":"' || sha256(a) || '","raw_sha256":"' || sha256(a) || '"}' AS line FROM d"""
    cents = "lpad((m::DECIMAL(18,2) * 100)::BIGINT::VARCHAR, 9, '0') || 'c'"
    lines = " UNION ALL ".join((token, shown("AMOUNT", "m", cents), shown("DR-CR-IND", "p", "lower(hex(encode(p)))"), shown("FILLER", "''", f"'{'20' * 13}'"), shown("REC-TYPE", "'D'", "'44'")))
    return f"""WITH d AS ({_PILOT}), l AS ({lines}), h AS (SELECT sha256(string_agg(line || chr(10), '' ORDER BY k, field)) AS h, count(*) AS n FROM l)
        SELECT * FROM (VALUES ('notes', sha256('notes')), ('complete', 'true'), ('done redaction', 'true'), ('done extract', 'true'), ('done casefile', 'true')) AS t(item, text)
        UNION ALL SELECT 'rows redaction', n::VARCHAR FROM h UNION ALL SELECT 'rows fields', n::VARCHAR FROM h UNION ALL SELECT 'redaction sha256', h FROM h UNION ALL SELECT 'pin redaction', sha256('{{"hash": "' || h || '", "records": ' || n || '}}') FROM h"""


def _report() -> str:
    sums = f"SELECT (count(*) || '.00') AS n, CAST(sum({_PRICE}) FILTER ({_PAID}) AS DECIMAL(38,2))::VARCHAR AS d, CAST(sum({_PRICE}) FILTER (NOT {_PAID}) AS DECIMAL(38,2))::VARCHAR AS c FROM lineitem"
    total = lambda m, c: f"""'{{"declared": "' || {c} || '", "measure": "{m}", "observed": "' || {c} || '", "ok": true}}'"""
    line = lambda m, c: f"'| {m} | ' || {c} || ' | ' || {c} || ' | True |' || chr(10)"
    json_ = f"""'{{"balanced": true, "findings": [], "non_claims": ["posting", "ledger state", "business meaning"], "sources": {{"unit": "{_sha('unit-1')}"}}, "totals": [' || {total('record_count', 'n')} || ', ' || {total('debit_total', 'd')} || ', ' || {total('credit_total', 'c')} || ']}}'"""
    text = f"""'# Reconciliation' || chr(10) || chr(10) || 'Balanced: yes' || chr(10) || chr(10) || '| measure | declared | observed | ok |' || chr(10) || '|-|-|-|-|' || chr(10) || {line('record_count', 'n')} || {line('debit_total', 'd')} || {line('credit_total', 'c')} || chr(10)"""
    return f"WITH s AS ({sums}) SELECT 'json' AS format, {json_} AS text FROM s UNION ALL SELECT 'markdown', {text} FROM s"


def _sums(where: str, good: str) -> str:
    return f"SELECT 'sum' AS kind, 'L-PRICE' AS name, CAST(sum(CASE WHEN {good} THEN {_PRICE} END) AS DECIMAL(38,2))::VARCHAR AS total, count(*) FILTER ({good}) AS count FROM lineitem {where}"


def _customer_totals(where: str) -> str:
    t = f"FROM customer {where}"
    s = lambda n, e, d: f"SELECT 'sum' AS kind, '{n}' AS name, (CAST(sum({e}) AS DECIMAL(38,{d})))::VARCHAR || '/' || count(*) AS v {t}"
    ind = f"CASE WHEN {_BAL} < 0 THEN -1 WHEN {_BAL} > 5000 THEN 12 ELSE 0 END"
    return f"SELECT 'records' AS kind, '' AS name, '-/' || count(*) AS v {t} UNION ALL {s('C-KEY', 'c_custkey', 0)} UNION ALL {s('C-BALANCE', _BAL, 2)} UNION ALL {s('C-OWED', _BAL, 2)} UNION ALL {s('C-OWED-IND', ind, 0)}"


ORACLE_SQL = {
    "decode_display": f"SELECT o_orderkey AS order_key, {_DATE}::BIGINT AS order_date FROM orders",
    "decode_comp3": f"SELECT l_orderkey AS order_key, l_linenumber::BIGINT AS line_no, CAST(l_quantity AS DECIMAL(18,2)) AS quantity, {_PRICE} AS price FROM lineitem",
    "decode_comp": "SELECT o_orderkey AS order_key, o_custkey AS cust FROM orders",
    "decode_comp5": "SELECT o_orderkey AS order_key, o_custkey - 500 AS delta FROM orders",
    "decode_compx": "SELECT o_orderkey AS order_key, o_orderkey * 7 AS code FROM orders",
    "decode_comp6": "SELECT o_orderkey AS order_key, o_orderkey % 1000000000 AS serial FROM orders",
    "decode_cp500_text": "SELECT c_custkey AS cust_key, c_name AS name, c_mktsegment AS segment FROM customer",
    "decode_cp500_zoned": f"SELECT c_custkey AS cust_key, {_BAL} AS balance, {_BAL} AS owed FROM customer",
    "decode_edited": f"SELECT {_INDEX} AS record_index, lpad(format('{{:,.2f}}', l_extendedprice), 10, ' ') AS shown, {_PRICE} AS amount FROM lineitem",
    "conditions_88": "SELECT o_orderkey AS record_index, o_orderstatus = 'O' AS is_open, o_orderstatus = 'F' AS is_filled, o_orderstatus IN ('F', 'P') AS is_settled FROM orders",
    "conditions_range": "SELECT p_partkey AS record_index, p_size BETWEEN 1 AND 10 AS small, p_size BETWEEN 40 AND 999 AS large FROM part",
    "control_totals": f"""SELECT 'records' AS kind, '' AS name, NULL AS total, count(*) AS count FROM lineitem
        UNION ALL SELECT 'sum', 'L-KEY', CAST(sum(l_orderkey) AS DECIMAL(38,0))::VARCHAR, count(*) FROM lineitem UNION ALL SELECT 'sum', 'L-NO', CAST(sum(l_linenumber) AS DECIMAL(38,0))::VARCHAR, count(*) FROM lineitem
        UNION ALL SELECT 'sum', 'L-QTY', CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2))::VARCHAR, count(*) FROM lineitem UNION ALL {_sums('', 'true')}
        UNION ALL SELECT 'condition', 'RETURNED', NULL, count(*) FILTER (l_returnflag = 'R') FROM lineitem""",
    "dirty_evidence": f"SELECT {_INDEX} AS record_index, 'L-PRICE' AS invalid FROM lineitem WHERE l_orderkey % 97 = 0",
    "dirty_totals": f"{_sums('', 'l_orderkey % 97 <> 0')} UNION ALL SELECT 'invalid', 'L-PRICE', NULL, count(*) FILTER (l_orderkey % 97 = 0) FROM lineitem",
    "explain_long": "SELECT n_nationkey::BIGINT AS record_index, 'N-KEY' AS name, n_nationkey::VARCHAR AS value, lower(hex(encode(lpad(n_nationkey::VARCHAR, 4, '0')))) AS raw_hex FROM nation UNION ALL SELECT n_nationkey, 'N-NAME', n_name, lower(hex(encode(rpad(n_name, 15, ' ')))) FROM nation UNION ALL SELECT n_nationkey, 'N-REGION', n_regionkey::VARCHAR, lpad(lower(to_hex(n_regionkey)), 2, '0') FROM nation",
    "explain_one": "SELECT n_nationkey::BIGINT AS record_index, 'N-NAME' AS name, 4 AS \"offset\", 15 AS size, n_name AS value, true AS valid, sha256(rpad(n_name, 15, ' ')) AS raw_sha256 FROM nation WHERE n_nationkey = 7",
    "variant_route": f"SELECT o_orderkey * 10 AS record_index, '(unknown)' AS variant, '48' AS disc_hex, 'H' AS disc_text FROM orders UNION ALL SELECT {_INDEX}, 'detail', '44', 'D' FROM lineitem",
    "variant_counts": "SELECT 'detail' AS variant, count(*) AS records FROM lineitem UNION ALL SELECT 'trailer', 0 UNION ALL SELECT 'void', 0 UNION ALL SELECT '(unknown)', count(*) FROM orders",
    "banking_reconcile": f"""WITH s AS (SELECT CAST(count(*) AS DECIMAL(38,2)) AS n, CAST(sum({_PRICE}) FILTER ({_PAID}) AS DECIMAL(38,2)) AS d, CAST(sum({_PRICE}) FILTER (NOT {_PAID}) AS DECIMAL(38,2)) AS c FROM lineitem)
        SELECT 'record_count' AS measure, n AS declared, n AS observed, true AS ok FROM s UNION ALL SELECT 'debit_total', d, d, true FROM s UNION ALL SELECT 'credit_total', c, c, true FROM s""",
    "banking_tampered": f"SELECT 'BANK-CONTROL-MISMATCH' AS rule_id, 'debit_total: declared ' || (s + 0.01)::DECIMAL(38,2) || ' != observed ' || s AS message FROM (SELECT CAST(sum({_PRICE}) FILTER ({_PAID}) AS DECIMAL(38,2)) AS s FROM lineitem)",
    "batch_control": f"SELECT l_orderkey AS batch, count(*) AS n_details, CAST(sum({_PRICE}) AS DECIMAL(18,2)) AS observed_total, count(*) + CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END AS declared_count, l_orderkey % 50 <> 0 AS ok FROM lineitem GROUP BY l_orderkey",
    "record_hash": f"SELECT n_nationkey::BIGINT AS record_index, {_NATION_SHA} AS record_sha256 FROM nation",
    "posting_sequence_dups": _DUPS,
    "posting_sequence_gaps": _GAPS,
    "posting_txn_dups": _AGAIN,
    "posting_chain": f"""WITH RECURSIVE r AS (SELECT n_nationkey AS k, {_NATION_HEX} AS x FROM nation), c AS (SELECT k, sha256(unhex(x)) AS h FROM r WHERE k = 0 UNION ALL SELECT r.k, sha256(unhex(hex(encode(c.h)) || r.x)) FROM r JOIN c ON r.k = c.k + 1)
        SELECT h AS hash, (SELECT count(*) FROM nation) AS records FROM c ORDER BY k DESC LIMIT 1""",
    "batch_chain": f"{_LINKS} SELECT no::BIGINT AS batch_no, prev_hash, link_hash FROM c",
    "batch_chain_verify": "SELECT count(*) AS links, 2::BIGINT AS first_broken FROM region",
    "db2_indicators": f"SELECT c_custkey AS record_index, CASE WHEN b < 0 THEN 'null' WHEN b > 5000 THEN 'truncated' ELSE 'present' END AS status, CASE WHEN b >= 0 THEN b::VARCHAR END AS value, CASE WHEN b > 5000 THEN 12::BIGINT END AS original_length FROM (SELECT c_custkey, {_BAL} AS b FROM customer)",
    "sentinel_scan": f"SELECT o_orderkey AS record_index, 'O-STATUS' AS field, 'still open' AS meaning, 'O' AS value FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'O-DATE', 'day of note', '19950101' FROM orders WHERE {_DATE} = '19950101'",
    "date_validate": f"SELECT o_orderkey AS record_index, CASE WHEN o_orderkey % 17 = 0 THEN '00000000' WHEN o_orderkey % 13 = 0 THEN strftime(o_orderdate, '%Y%m') || '32' ELSE {_DATE} END AS text, CASE WHEN o_orderkey % 17 = 0 THEN 'declared_sentinel' WHEN o_orderkey % 13 = 0 THEN 'invalid_calendar' ELSE 'valid' END AS status FROM orders",
    "currency_scale": f"SELECT o_orderkey AS record_index, 'O-TOTAL' AS field, {_TOTAL}::VARCHAR AS value, '' AS rule_ids, false AS admitted_as_money FROM orders UNION ALL SELECT o_orderkey, 'O-TOTAL', {_TOTAL}::VARCHAR, 'CURRENCY-SCALE-MISMATCH', false FROM orders UNION ALL SELECT o_orderkey, 'O-CUST', o_custkey::VARCHAR, 'CURRENCY-ROLE-NOT-AMOUNT', false FROM orders",
    "redefines_views": "SELECT s_suppkey AS record_index, 'S-BODY' AS view, 'S-BODY' AS field, rtrim(s_name[1:20]) AS value, s_suppkey % 2 <> 0 AS active FROM supplier UNION ALL SELECT s_suppkey, 'S-SPLIT', 'S-HEAD', rtrim(s_name[1:8]), s_suppkey % 2 = 0 FROM supplier UNION ALL SELECT s_suppkey, 'S-SPLIT', 'S-TAIL', rtrim(s_name[9:20]), s_suppkey % 2 = 0 FROM supplier",
    "redact_tokens": "SELECT c_custkey AS record_index, 'C-NAME' AS field, 'TOK-' || sha256('pilot:' || c_name)[1:12] AS value FROM customer",
    "redact_hashes": f"""WITH v AS (SELECT c_custkey AS k, c_mktsegment AS s, {_BAL} AS b FROM customer), h AS (SELECT k, 'C-BALANCE' AS field, b::VARCHAR AS v FROM v UNION ALL SELECT k, 'C-OWED', b::VARCHAR FROM v UNION ALL SELECT k, 'C-OWED-IND', (CASE WHEN b < 0 THEN -1 WHEN b > 5000 THEN 12 ELSE 0 END)::VARCHAR FROM v)
        SELECT k AS record_index, field, 'hash_only' AS action, NULL AS value, sha256(v) AS value_sha256, 'PRIVACY-UNLISTED-FIELD' AS rule_id FROM h UNION ALL SELECT k, 'C-SEGMENT', 'hash', NULL, sha256(s), '' FROM v UNION ALL SELECT k, 'C-KEY', 'allow', k::VARCHAR, sha256(k::VARCHAR), '' FROM v""",
    "diff_fields": f"""SELECT coalesce(a.k, b.k) AS record_index, 'C-SEGMENT' AS name, CASE WHEN b.k IS NULL THEN 'DIFF-MISSING-FIELD' ELSE 'DIFF-FIELD-MISMATCH' END AS rule_id, a.s AS "left", b.s AS "right" FROM ({_SEG}) a FULL OUTER JOIN ({_SHIFTED}) b ON a.k = b.k WHERE a.s IS DISTINCT FROM b.s""",
    "diff_totals": f"""SELECT kind, name, 'DIFF-CONTROL-TOTAL-MISMATCH' AS rule_id, a.v AS "left", b.v AS "right" FROM ({_customer_totals('')}) a JOIN ({_customer_totals('WHERE c_custkey % 11 <> 0')}) b USING (kind, name) WHERE a.v <> b.v""",
    "transform_add": f"SELECT o_orderkey AS record_index, CAST(trunc(({_TOTAL} + 12.345) * 100) / 100 AS DECIMAL(18,2)) AS total, true AS changed FROM orders",
    "transform_set_true": "SELECT o_orderkey AS record_index, 'F' AS status, o_orderstatus <> 'F' AS changed FROM orders",
    "transform_delta": "SELECT o_orderkey AS record_index, 'O-STATUS' AS name, o_orderstatus AS before, 'O' AS after FROM orders WHERE o_orderstatus <> 'O'",
    "status_totals": f"SELECT o_orderstatus AS status, count(*) AS orders, CAST(sum({_TOTAL}) AS DECIMAL(18,2)) AS total FROM orders GROUP BY o_orderstatus",
    "raw_slices": "SELECT n_nationkey::BIGINT AS record_index, lower(hex(encode(rpad(n_name, 15, ' ')))) AS raw_hex, 20::BIGINT AS record_len FROM nation",
    "posting_findings": f"SELECT 'POSTING-DUPLICATE-SEQUENCE' AS rule_id, count(*) AS n FROM ({_DUPS}) UNION ALL SELECT 'POSTING-SEQUENCE-GAP', count(*) FROM ({_GAPS}) UNION ALL SELECT 'POSTING-DUPLICATE-TXN-ID', count(*) FROM ({_AGAIN})",
    "record_lines": f"""SELECT n_nationkey::BIGINT AS record_index, '{{"record_index":' || n_nationkey || ',"fields":{{"N-KEY":"' || n_nationkey || '","N-NAME":"' || n_name || '","N-REGION":"' || n_regionkey || '"}},"conditions":{{}},"audit":{{"raw_offset":' || n_nationkey * 20 || ',"raw_len":20,"record_sha256":"' || {_NATION_SHA} || '"}}}}' AS line FROM nation""",
    "fixture_replay": "SELECT * FROM (VALUES ('FIXTURE-VERDICT-MISMATCH', 'tampered: expected mismatch, got pass'), ('FIXTURE-NON-CLAIM-REQUIRED', 'tampered'), ('FIXTURE-FINDING-MISMATCH', 'left BANK-NO-TRAILER'), ('FIXTURE-FINDING-MISMATCH', 'right BANK-CONTROL-MISMATCH')) AS t(rule_id, detail)",
    "ingest_records": f"SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS record_index, o_orderkey AS order_key, {_TOTAL} AS total, o_orderstatus AS status FROM orders",
    "ingest_nth": "SELECT 11::BIGINT AS record_index, 20 AS raw_len, false AS partial, n_name AS name FROM nation WHERE n_nationkey = 11",
    "ingest_spans": f"SELECT n_nationkey::BIGINT AS record_index, n_nationkey::BIGINT * 20 AS raw_offset, 20 AS raw_len, false AS partial, {_NATION_SHA} AS record_sha256 FROM nation UNION ALL SELECT 25, 500, 7, true, sha256('0099CUT')",
    "ingest_manifest": " UNION ALL ".join((_manifest("clean", "", 0, 25, 0), _manifest("line-feed-reject", "0A", 1, 0, 2), _manifest("line-feed-allow", "0A", 1, 25, 0), _manifest("line-feed-strip", "0A", 1, 25, 0, stripped=True), _manifest("partial-reject", b"0099CUT".hex(), 7, 0, 2), _manifest("partial-evidence", b"0099CUT".hex(), 7, 26, 1, partial=True))),
    "reconcile_receipt": f"SELECT 'nation' AS fixture, '{_sha(NATION.text)}' AS copybook_sha256, count(*) AS record_count, 3 AS field_count, 0 AS condition_count, 0::BIGINT AS unsupported_count, sha256(string_agg(line || chr(10), '' ORDER BY k)) AS decode_output_sha256, true AS has_binary, false AS has_comp6 FROM (SELECT n_nationkey AS k, {_LINE} AS line FROM nation)",
    "reconcile_ledger": "SELECT 'field:X-BAD' AS unsupported, count(*) AS n FROM nation UNION ALL SELECT 'condition:X-ON', count(*) FROM nation UNION ALL SELECT 'all: field:X-BAD,condition:X-ON', 2 * count(*) FROM nation",
    "strict_decode": "SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation",
    "posting_manifest": f"{_NATION_CHAIN} SELECT 'unit-1' AS unit_id, (SELECT count(*) FROM nation) AS records, h AS last_hash, 0::BIGINT AS first_seq, 24::BIGINT AS last_seq, 0::BIGINT AS findings FROM c ORDER BY k DESC LIMIT 1",
    "extract_manifest": f"{_NATION_CHAIN} SELECT 'unit-1' AS unit, 'nation' AS source, (SELECT count(*) FROM nation) AS records, h AS chain_sha256, '{_sha(NATION.text)}' AS copybook_sha256 FROM c ORDER BY k DESC LIMIT 1",
    "chain_by_ranges": f"{_NATION_CHAIN} SELECT h AS hash, (SELECT count(*) FROM nation) AS records FROM c ORDER BY k DESC LIMIT 1",
    "order_chains": "SELECT l_orderkey AS unit, list_reduce(list(lpad(l_orderkey::VARCHAR, 10, '0') || lpad(l_linenumber::VARCHAR, 3, '0') || l_returnflag ORDER BY l_linenumber, l_returnflag), lambda h, x: sha256(h || x), '') AS hash, count(*) AS records FROM lineitem GROUP BY l_orderkey",
    "bank_report": _report(),
    "pilot_redaction": f"""WITH d AS ({_PILOT})
        SELECT k AS record_index, 'REC-TYPE' AS field, 'allow' AS action, false AS redacted, 'D' AS value, sha256('D') AS value_sha256 FROM d UNION ALL SELECT k, 'DR-CR-IND', 'allow', false, p, sha256(p) FROM d
        UNION ALL SELECT k, 'ACCT-ID', 'token', true, 'TOK-' || sha256('pilot:' || a)[1:12], sha256(a) FROM d UNION ALL SELECT k, 'AMOUNT', 'allow', false, m, sha256(m) FROM d""",
    "pilot_packet": _packet(),
    "currency_rules": f"""WITH o AS (SELECT o_orderkey AS k, {_TOTAL}::VARCHAR AS v FROM orders)
        SELECT k AS record_index, 'P-AMT' AS field, v AS value, 2 AS observed_scale, 'USD' AS code, '' AS rule_ids FROM o UNION ALL SELECT k, 'P-AMT', v, 2, NULL, 'CURRENCY-SCALE-MISMATCH,CURRENCY-MISSING-CODE' FROM o
        UNION ALL SELECT k, 'P-AMT', v, 2, NULL, '' FROM o UNION ALL SELECT k, 'P-RATE', '12.345', NULL, NULL, 'CURRENCY-ROLE-NOT-AMOUNT' FROM o UNION ALL SELECT k, 'P-GONE', NULL, NULL, NULL, 'CURRENCY-MISSING-FIELD' FROM o""",
    "redact_published": f"""WITH o AS (SELECT o_orderkey AS k, {_TOTAL}::VARCHAR AS v, {_CENTS} || 'c' AS x FROM orders)
        SELECT k AS record_index, 'P-AMT' AS field, 'hash' AS action, true AS redacted, NULL AS value, sha256(v) AS value_sha256, sha256(unhex(x)) AS raw_sha256, x AS raw_hex, 'PRIVACY-UNLISTED-FIELD' AS rule_id FROM o
        UNION ALL SELECT k, 'P-RATE', 'token', true, 'TOK-' || sha256('pilot:12.345')[1:12], sha256('12.345'), sha256('12345'), NULL, '' FROM o UNION ALL SELECT k, 'P-CODE', 'hash_only', true, NULL, sha256('USD'), sha256('USD'), NULL, '' FROM o""",
    "date_findings": """WITH n AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 17 = 0) AS zeros, count(*) FILTER (o_orderkey % 5 = 0) AS odd FROM orders)
        SELECT 'DATE-INVALID-CALENDAR-DATE' AS rule_id, 'D-DAY: invalid_calendar' AS message, zeros AS n FROM n UNION ALL SELECT 'DATE-SENTINEL-UNDECLARED', 'D-DAY: invalid_calendar', zeros FROM n UNION ALL SELECT 'DATE-INVALID-CALENDAR-DATE', 'D-JUL: invalid_calendar', odd FROM n
        UNION ALL SELECT 'DATE-INVALID-FORMAT', 'D-PACK: invalid_format', n FROM n UNION ALL SELECT 'DATE-MISSING-FIELD', 'D-NONE: missing', n FROM n""",
    "banking_decimals": """SELECT 'BANK-DIRTY-DETAIL' AS rule_id, count(*)::DECIMAL(38,2) AS n FROM lineitem UNION ALL SELECT 'BANK-NO-TRAILER', 2.00 UNION ALL SELECT 'observed record_count', count(*)::DECIMAL(38,2) FROM lineitem
        UNION ALL SELECT 'observed debit_total', 0.00 UNION ALL SELECT 'observed credit_total', 0.00""",
    "banking_inconsistent": f"""WITH s AS (SELECT count(*) || '.00' AS n, CAST(sum({_PRICE}) FILTER ({_PAID}) AS DECIMAL(38,2))::VARCHAR AS d, CAST(sum({_PRICE}) FILTER (NOT {_PAID}) AS DECIMAL(38,2))::VARCHAR AS c FROM lineitem)
        SELECT 'BANK-PROFILE-INCONSISTENT' AS rule_id, 'L-PRICE is not declared an amount; nothing is summed' AS message UNION ALL SELECT 'BANK-CONTROL-MISMATCH', 'debit_total: declared ' || d || ' != observed (not summed)' FROM s
        UNION ALL SELECT 'BANK-CONTROL-MISMATCH', 'credit_total: declared ' || c || ' != observed (not summed)' FROM s UNION ALL SELECT 'record_count', n FROM s UNION ALL SELECT 'debit_total', '(not summed)' UNION ALL SELECT 'credit_total', '(not summed)'""",
    "diff_note": f"""SELECT * FROM (VALUES ('equal, no oracle', 'DIFF-TARGET-NOT-ORACLE', '{views.NOT_ORACLE.format("not_oracle").replace("'", "''")}'), ('fields not allowed', 'DIFF-TARGET-NOT-ORACLE', '{views.NOT_ORACLE.format("declared_baseline").replace("'", "''")}'),
        ('fields allowed', 'DIFF-MISSING-FIELD', '3 N-KEY'), ('fields allowed', 'DIFF-MISSING-FIELD', '3 N-NAME'), ('fields allowed', 'DIFF-MISSING-FIELD', '3 N-REGION'), ('one hash', 'DIFF-HASH-MISMATCH', 'out')) AS t("case", rule_id, detail)""",
    "json_dialects": """SELECT r_regionkey, '{"v":"' || r_name || '\\u0008\\u000c\\n\\t\\u000b\\u001f\\\\b\\""}' AS short, '{"v":"' || r_name || '\\u0008\\u000c\\u000a\\u0009\\u000b\\u001f\\\\b\\""}' AS long FROM region""",
    "field_map": f"""WITH c AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS s, {_BAL}::VARCHAR AS b, {_OWED_IND} AS i FROM customer)
        SELECT k AS record_index, 'C-KEY' AS field, 0 AS "offset", 9 AS size, 'allow' AS action, sha256(k::VARCHAR) AS value_sha256 FROM c UNION ALL SELECT k, 'C-NAME', 9, 25, 'token', sha256(n) FROM c UNION ALL SELECT k, 'C-SEGMENT', 34, 12, 'hash', sha256(s) FROM c
        UNION ALL SELECT k, 'C-BALANCE', 46, 9, 'hash_only', sha256(b) FROM c UNION ALL SELECT k, 'C-OWED', 55, 5, 'hash_only', sha256(b) FROM c UNION ALL SELECT k, 'C-OWED-IND', 60, 2, 'hash_only', sha256(i) FROM c""",
}
