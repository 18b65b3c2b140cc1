"""Rules as tables, records saved by jobs that commit, reconciliation in one pass, and chains from ordered files."""

import hashlib
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recordloom.functions.decode import CP500
from recordloom.operators import custody, profiles, recon, rule_tables
from recordloom.plans.copybook import compile_layout
from recordloom.sources.fixedrec import Policy, read_records, save_records

LAYOUT = compile_layout("01 R.\n05 A PIC X(2).\n05 N PIC 9(3).\n05 D PIC 9(8).\n")
RULE = "field string, meaning string, value string, raw_hex string"


def rows(spark, *records):
    return spark.createDataFrame([(i, bytes(r)) for i, r in enumerate(records)], "record_index long, record binary")


def test_sentinel_tables_equal_sentinel_expressions(spark):
    df = rows(spark, b"ab00120200101", b"zz99900000000", b"  xx", b"ab999", b"")
    rules = [("A", "one", "ab", None), ("A", "two", "ab", None), ("N", "nines", "999", None), ("N", "raw", None, b"001".hex().upper()), ("A", "blank", "", None), ("N", "none", None, None), ("Z", "gone", "1", None), (None, "x", "1", None)]
    table = spark.createDataFrame(rules + rules[:2], RULE)
    got = sorted(map(str, rule_tables.sentinels_by_table(df, LAYOUT, table).collect()))
    want = profiles.sentinel_scan(df, LAYOUT, tuple(profiles.Sentinel(*r) for r in rules[:5]))
    assert got == sorted(map(str, want.collect())) and len(got) == 8
    assert [r["message"] for r in rule_tables.fieldless(table, LAYOUT).orderBy("message").collect()] == ["no field (null)", "no field Z"]
    assert rule_tables.sentinels_by_table(df, LAYOUT, table.limit(0)).count() == 0 == rule_tables.sentinels_by_table(df.limit(0), LAYOUT, table).count()
    ebcdic = rows(spark, "ab001".encode("cp500"))
    assert rule_tables.sentinels_by_table(ebcdic, LAYOUT, table, CP500).count() == 2


def test_many_rules_are_broadcast_and_more_are_shuffled(spark, monkeypatch):
    df = rows(spark, *(b"ab%03d20200101" % i for i in range(500)))
    rules = spark.range(10_000).select(F.lit("N").alias("field"), F.lit("m").alias("meaning"), (F.col("id") * 2).cast("string").alias("value"), F.lit(None).cast("string").alias("raw_hex"))
    one = rule_tables.sentinels_by_table(df, LAYOUT, rules)
    assert "BroadcastHashJoin" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 250
    monkeypatch.setattr(rule_tables, "RULES_BROADCAST", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        other = rule_tables.sentinels_by_table(df, LAYOUT, rules)
        assert "SortMergeJoin" in other._jdf.queryExecution().executedPlan().toString() and other.count() == 250
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_date_tables_equal_date_rules(spark):
    df = rows(spark, *(b"ab001" + d for d in (b"20200229", b"20210229", b"00000000", b"99999999", b"2020 101", b"")))
    rules = spark.createDataFrame([("D", "YYYYMMDD", True), ("N", "YYDDD", None), ("Z", "YYYYMMDD", None)], "field string, format string, require_sentinel boolean")
    known = spark.createDataFrame([("D", "00000000"), ("D", "00000000"), ("D", None)], "field string, text string")
    got = {(r["record_index"], r["field"], r["text"], r["status"], tuple(r["rule_ids"])) for r in rule_tables.dates_by_table(df, LAYOUT, rules, known).collect()}
    want = profiles.date_validate(df, LAYOUT, (profiles.DateRule("D", sentinels=("00000000",), require_sentinel=True), profiles.DateRule("N", "YYDDD")))
    assert got == {(r["record_index"], r["field"], r["text"], r["status"], tuple(r["rule_ids"])) for r in want.collect()}
    bad = spark.createDataFrame([("D", "DDMMYY", None)], rules.schema)
    with pytest.raises(PySparkException, match="unknown date format"):
        rule_tables.dates_by_table(df, LAYOUT, bad, known).collect()


def names(folder):
    return sorted(n for n in os.listdir(folder) if not n.endswith(".crc"))


def test_saved_records_are_read_in_order(spark, tmp_path):
    at = str(tmp_path / "out")
    df = rows(spark, *(b"%05d" % i for i in range(200))).repartition(7)
    told = save_records(df, at, 4).collect()
    assert names(at) == sorted([r["file"] for r in told] + ["_SUCCESS"]) and sum(r["records"] for r in told) == 200 and sum(r["bytes"] for r in told) == 1000
    got = read_records(spark, at, Policy(5)).orderBy("record_index").collect()
    assert [bytes(r["record"]) for r in got] == [b"%05d" % i for i in range(200)]
    save_records(df.where("record_index < 3"), at, 2, prefix="q")
    assert read_records(spark, at, Policy(5)).count() == 203
    save_records(df.where("record_index < 3"), at, 2, mode="overwrite")
    assert read_records(spark, at, Policy(5)).count() == 3 == sum(x["records"] for x in json.load(open(f"{at}/_SUCCESS"))["files"])
    save_records(df.limit(0), at, mode="overwrite")
    assert names(at) == ["_SUCCESS"]


def test_a_killed_task_leaves_nothing(spark, tmp_path):
    """One task dies in the middle of its records, others have finished: nothing is moved in, what was there stays."""
    at = str(tmp_path / "out")
    save_records(rows(spark, b"aaaaa", b"bbbbb"), at, 1)
    before = {n: open(f"{at}/{n}", "rb").read() for n in names(at)}
    df = rows(spark, *(b"%05d" % i for i in range(100)))
    broken = df.withColumn("record", F.when(F.col("record_index") == 77, F.raise_error(F.lit("killed")).cast("binary")).otherwise(F.col("record")))
    for mode in ("append", "overwrite"):
        with pytest.raises(PySparkException):
            save_records(broken, at, 8, mode=mode, prefix="new")
        assert {n: open(f"{at}/{n}", "rb").read() for n in names(at)} == before


def test_one_pass_tells_what_three_told(spark, tmp_path):
    text = "01 R.\n05 A PIC S9(3)V99 COMP-3.\n05 S PIC X.\n88 ON VALUE 'Y'.\n05 U PIC 9(2) COMP-1.\n"
    layout = compile_layout(text)
    df = rows(spark, *(bytes([i % 10 << 4, 0x50, 0x0C if i % 7 else 0x01]) + (b"Y", b"N")[i % 2 : i % 2 + 1][0] + b"12" for i in range(300)), b"").repartition(5)
    df = df.withColumns({"raw_offset": F.col("record_index") * 6, "raw_len": F.length("record")})
    made = recon.reconcile_pass(df, text, str(tmp_path / "lines"))
    whole = recon.reconcile(df, layout, "x")
    assert sorted(map(str, made.totals.collect())) == sorted(map(str, recon.control_totals(df, layout).collect()))
    assert sorted(map(str, made.ledger.collect())) == sorted(map(str, whole.ledger.collect()))
    assert made.output_sha256 == whole.receipt.first()["decode_output_sha256"] and made.records == 301
    assert sorted(map(str, made.lines.collect())) == sorted(map(str, whole.lines.collect()))
    assert set(made.seconds) == {"parse", "record", "aggregate"} and all(s >= 0 for s in made.seconds.values())
    none = recon.reconcile_pass(df.limit(0), text, str(tmp_path / "none"))
    assert none.records == 0 and none.output_sha256 == hashlib.sha256(b"").hexdigest() and none.totals.where("kind = 'records'").first()["count"] == 0


def chain(records):
    state = ""
    for r in records:
        state = hashlib.sha256(state.encode() + r).hexdigest()
    return state


def test_chains_do_not_depend_on_partitions(spark):
    records = [b"%04d" % (i * 7919 % 1000) for i in range(1000)]
    df = spark.createDataFrame([(i // 3, r) for i, r in enumerate(records)], "record_index long, record binary")  # three of each number
    want = chain(r for _, r in sorted((i // 3, r) for i, r in enumerate(records)))
    for d, most in ((df.repartition(1), None), (df.repartition(9), None), (df.repartition(5), 70)):
        assert tuple(custody.record_chain(d, most=most).first()) == (want, 1000)
    assert tuple(custody.record_chain(df.limit(0)).first()) == tuple(custody.record_chain(df.limit(0), most=5).first()) == ("", 0)
    units = df.withColumn("u", F.when(F.col("record_index") % 3 == 0, None).otherwise((F.col("record_index") % 3 == 1).cast("string")))
    got = {r["u"]: (r["hash"], r["records"]) for r in custody.unit_chains(units.repartition(6), "u").collect()}
    of = lambda k: [r for _, r in sorted((i // 3, r) for i, r in enumerate(records) if i // 3 % 3 == k)]
    assert got == {None: (chain(of(0)), len(of(0))), "true": (chain(of(1)), len(of(1))), "false": (chain(of(2)), len(of(2)))}
    assert custody.unit_chains(units.limit(0), "u").count() == 0


def test_short_values_leak_through_their_own_field(spark):
    from recordloom.plans.pilot import Evidence, Pilot, leaks
    from recordloom.operators.route import Control, Variant, VariantSpec

    layout = compile_layout("01 D.\n05 T PIC X.\n05 P PIC X.\n05 PIN PIC X(3).\n05 AMT PIC 9(3)V99.\n")
    spec = VariantSpec(0, 1, (Variant("d", b"D", layout), Variant("t", b"T", layout)))
    control = Control("d", "t", "AMT", "P", ("D",), ("C",), "AMT", "AMT", "AMT", {"AMT": "amount"})
    pilot = Pilot("u", spec, control, custody.PostingSpec("u", "X"), profiles.Redaction("s", {"T": "allow", "P": "allow", "AMT": "allow", "PIN": "token"}))
    df = rows(spark, b"DD12 00100", b"DD   00200")
    schema = "record_index long, field string, value string"
    shown = lambda *r: Evidence({"note": "12 is said here"}, {"rows": spark.createDataFrame(list(r), schema)})
    assert leaks(df, shown((0, "PIN", "12")), pilot) == ["rows"]
    assert leaks(df, shown((0, "PIN", "TOK-12"), (0, "AMT", "12"), (1, "PIN", "12"), (1, "PIN", ""), (0, "PIN", None)), pilot) == []
