"""Operators of the engine on small inline fixtures: sources, dirty data, routing, custody, profiles, views, workflow."""

import json
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recordloom.functions.decode import CP500, UNSUPPORTED, condition, decode, decode_long, number, valid, value
from recordloom.functions.encode import encode_record
from recordloom.operators import custody, profiles, recon, route, views
from recordloom.plans.copybook import CopybookError, compile_layout
from recordloom.plans.pilot import Evidence, LeakError, Pilot, leaks, run_pilot
from recordloom.sources.fixedrec import ExitCode, IngestError, Policy, examine, file_manifest, read_records


def rows(spark, *records):
    return spark.createDataFrame([(i, bytes(r)) for i, r in enumerate(records)], "record_index long, record binary")


def one(spark, layout, name, record, encoding="ascii"):
    f = layout.field(name)
    r = rows(spark, record).select(value(f, encoding).alias("v"), valid(f, encoding).alias("ok")).first()
    return r["v"], r["ok"]


def test_unit_vector(spark):
    layout = compile_layout("01 R.\n05 A PIC 9(3).\n05 B PIC X(4).\n05 C PIC S9(3)V99 COMP-3.\n")
    r = decode(rows(spark, b"042ANNA\x01\x23\x4d"), layout).first()
    assert (r["A"], r["B"], r["C"]) == (Decimal(42), "ANNA", Decimal("-12.34"))


@pytest.mark.parametrize(
    ("pic", "raw", "encoding", "want", "ok"),
    [
        ("9(4)", "f1f2f3f4", CP500, "1234", True),
        ("S9(3)", "f1f2d3", CP500, "-123", True),
        ("S9(3)", "313273", "ascii", "-123", True),
        ("S9(3) SIGN LEADING SEPARATE", "2d313233", "ascii", "-123", True),
        ("S9(3) SIGN TRAILING SEPARATE", "3132332b", "ascii", "123", True),
        ("9(4) COMP-6", "1234", "ascii", "1234", True),
        ("S9(4) COMP-6", "1234", "ascii", UNSUPPORTED, False),
        ("S9(3)V99 COMP-3", "01234f", "ascii", "12.34", True),
        ("S9(3)V99 COMP-3", "012345", "ascii", None, False),
        ("S9(4) COMP-5", "feff", "ascii", "-2", True),
        ("S9(4) COMP", "fffe", "ascii", "-2", True),
        ("S9(18) COMP", "ffffffffffffffff", "ascii", "-1", True),
        ("9(18) COMP", "ffffffffffffffff", "ascii", "18446744073709551615", True),
        ("9(3)", "20313a", "ascii", None, False),
        ("ZZ9.99", "f1f2f34bf4f5", CP500, "(edited picture under EBCDIC: deferred)", False),
        ("ZZ9.99", "20203a2e3030", "ascii", "(edited decode failed)", False),
        ("ZZ%9", "20202031", "ascii", UNSUPPORTED, False),
        ("9(4) COMP-1", "31323334", "ascii", UNSUPPORTED, False),
        ("X(3)", "41ff20", "ascii", "A�", True),
        ("X(4)", "c1c3c440", CP500, "ACD", True),
        ("X(9)", "41", "ascii", "(record too short for field)", False),
    ],
)
def test_storage(spark, pic, raw, encoding, want, ok):
    layout = compile_layout(f"01 R.\n05 A PIC {pic}.\n")
    assert one(spark, layout, "A", bytes.fromhex(raw), encoding) == (want, ok)


def test_edited_signs(spark):
    layout = compile_layout("01 R.\n05 A PIC ZZ9.99CR.\n05 B PIC -ZZ9.\n")
    r = rows(spark, b"  1.50CR-  7", b" 12.00     9").select(number(layout.field("A")).alias("a"), number(layout.field("B")).alias("b")).collect()
    assert [(x["a"], x["b"]) for x in r] == [(Decimal("-1.50"), Decimal(-7)), (Decimal("12.00"), Decimal(9))]


def test_copybook_forms():
    layout = compile_layout("01 R.\n05 A PIC IS X.\n88 K VALUES ARE 'A' 'B'.\n05 T OCCURS 2 TIMES.\n10 U PIC 9(2).\n05 V REDEFINES T PIC X(4).\n05 FILLER PIC X.\n")
    assert [(f.name, f.offset, f.size) for f in layout.elementary()] == [("A", 0, 1), ("U(1)", 1, 2), ("U(2)", 3, 2), ("V", 1, 4), ("FILLER", 5, 1)]
    assert layout.record_len == 6 and layout.conditions[0].values == (("A", None), ("B", None)) and layout.field("R.A").offset == 0
    with pytest.raises(CopybookError):
        compile_layout("01 R.\n COPY GONE.\n")
    with pytest.raises(CopybookError):
        compile_layout("01 R.\n05 A PIC X.\n05 A PIC X.\n").check_keys()


def test_conditions_are_tri_state(spark):
    layout = compile_layout("01 R.\n05 A PIC X(3).\n88 IS-A VALUE 'A'.\n05 N PIC 9.\n88 LOW VALUE 1 THRU 3.\n")
    got = rows(spark, b"A  2", b"B  9", b"A").select(*(condition(c, layout).alias(c.name) for c in layout.conditions)).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (None, None)]


@pytest.mark.parametrize(("data", "policy", "records", "code"), [
    (b"a" * 110, {}, 2, 0), (b"", {}, 0, 0), (b"a" * 111, {}, None, 2), (b"a" * 110 + b"\n", {}, None, 2), (b"a" * 110 + b"\n", {"newline": "allow"}, 2, 0), (b"a" * 110 + b"\n", {"newline": "strip"}, 2, 0), (b"a" * 120, {"partial": "evidence"}, 3, 1),
])
def test_ingest(spark, tmp_path, data, policy, records, code):
    at = tmp_path / "in.dat"
    at.write_bytes(data)
    p = Policy(55, **policy)
    m = file_manifest(spark, str(at), p).first()
    assert m["exit_code"] == code
    if records is None:
        with pytest.raises(IngestError):
            examine(str(at), p)
        return
    df = read_records(spark, str(at), p, split_bytes=55)
    got = df.orderBy("record_index").collect()
    assert len(got) == records == m["record_count"] and b"".join(bytes(r["record"]) for r in got) == data.removesuffix(b"\n")
    assert m["last_offset"] == (records - 1) * 55 if records else m["first_offset"] == -1
    if records:
        assert df.where(f"record_index = {records - 1}").first()["raw_offset"] == (records - 1) * 55
        assert got[-1]["partial"] == (code == 1)


def test_no_record_length():
    with pytest.raises(IngestError) as e:
        Policy(0)
    assert e.value.code == ExitCode.INTERNAL


def test_totals_dirty_and_strict(spark):
    layout = compile_layout("01 R.\n05 A PIC S9(3)V99 COMP-3.\n05 S PIC X.\n88 ON VALUE 'Y'.\n")
    df = rows(spark, b"\x01\x00\x0cY", b"\x00\x50\x0dN", b"\x00\x50\x01Y")
    t = {(r["kind"], r["name"]): (r["total"], r["count"]) for r in recon.control_totals(df, layout).collect()}
    assert t[("sum", "A")] == ("5.00", 2) and t[("invalid", "A")] == (None, 1) and t[("condition", "ON")] == (None, 2)
    assert [r["invalid"] for r in recon.dirty_fields(df, layout).orderBy("record_index").collect()] == [[], [], ["A"]]
    with pytest.raises(PySparkException, match="record 2"):
        recon.strict_decode(df, layout).collect()
    assert recon.strict_decode(df.where("record_index < 2"), layout).count() == 2


def test_set_true_and_transform(spark):
    layout = compile_layout("01 R.\n05 A PIC X(3).\n88 ON VALUE 'A'.\n05 B PIC 9.\n88 LOW VALUE 1 THRU 3.\n05 C PIC S9(3) COMP-3.\n88 SOME VALUE 1 THRU 5.\n")
    df = rows(spark, b"ZZZ9\x99\x9c")
    hexes = [recon.transform(df, layout, recon.Transform("set_true", n))[0].first()["after"].hex() for n in ("ON", "LOW", "SOME")]
    assert [h[:6] for h in hexes][0] == "412020" and hexes[1][6:8] == "31" and hexes[2][8:] == "001c"
    out, bad = recon.transform(df, layout, recon.Transform("add", "C", "1"))
    assert not out.first()["changed"] and bad.first()["rule_id"] == "TRANSFORM-ARITH-FAILED"
    out, bad = recon.transform(df, layout, recon.Transform("subtract", "C", "1000.9"))
    assert out.first()["after"][4:].hex() == "001d" and bad.count() == 0
    for t, rule in ((recon.Transform("set_true", "NO"), "TRANSFORM-UNDECLARED-CONDITION"), (recon.Transform("add", "NO", "1"), "TRANSFORM-UNDECLARED-FIELD"), (recon.Transform("add", "A", "1"), "TRANSFORM-NOT-NUMERIC"), (recon.Transform("add", "C", None), "TRANSFORM-NO-AMOUNT")):
        assert recon.transform(df, layout, t)[1].first()["rule_id"] == rule
    assert recon.transform(rows(spark, b"Z"), layout, recon.Transform("add", "C", "1"))[1].first()["rule_id"] == "TRANSFORM-SIZE"


HEAD = compile_layout("01 H.\n05 T PIC X.\n05 D PIC X(29).\n")
DETAIL = compile_layout("01 D.\n05 T PIC X.\n05 ID PIC 9(10).\n05 P PIC X.\n05 AMT PIC S9(7)V99 COMP-3.\n05 RATE PIC S9(1)V9(4) COMP-3.\n05 MEMO PIC X(10).\n")
TRAIL = compile_layout("01 T.\n05 T PIC X.\n05 N PIC 9(6).\n05 DR PIC S9(9)V99 COMP-3.\n05 CR PIC S9(9)V99 COMP-3.\n05 F PIC X(11).\n")
SPEC = route.VariantSpec(0, 1, (route.Variant("head", b"H", HEAD), route.Variant("detail", b"D", DETAIL), route.Variant("trail", b"T", TRAIL)))
CONTROL = route.Control("detail", "trail", "AMT", "P", ("D",), ("C",), "N", "DR", "CR", {"AMT": "amount", "RATE": "rate"})


def file_of(spark, details, trailer=None):
    d = spark.createDataFrame([(i + 1, str(i), p, Decimal(a)) for i, (p, a) in enumerate(details)], "i long, id string, p string, a decimal(18,2)")
    out = d.select(F.col("i").alias("record_index"), encode_record(DETAIL, {"T": F.lit("D"), "ID": F.col("id").cast("long"), "P": F.col("p"), "AMT": F.col("a"), "RATE": F.lit(Decimal("1.5")), "MEMO": F.lit("memo")}).alias("record"))
    out = out.union(rows(spark, b"H" + b" " * 29))
    if trailer:
        n, dr, cr = trailer
        one_ = spark.range(1).select(F.lit(99).cast("long").alias("record_index"), encode_record(TRAIL, {"T": F.lit("T"), "N": F.lit(n), "DR": F.lit(Decimal(dr)), "CR": F.lit(Decimal(cr)), "F": F.lit("")}).alias("record"))
        out = out.union(one_)
    return spark.createDataFrame(out.collect(), out.schema)


def test_banking(spark):
    details = [("D", "100.00"), ("C", "50.50"), ("D", "-0.50")]
    totals, found = route.reconcile_banking(file_of(spark, details, (3, "99.50", "50.50")), SPEC, CONTROL)
    assert all(r["ok"] for r in totals.collect()) and found.count() == 0
    bad = file_of(spark, [*details, ("X", "1.00")], (3, "99.50", "50.51")).union(rows(spark, b"?" * 30).withColumn("record_index", F.lit(50).cast("long")))
    rules = {r["rule_id"]: r["n"] for r in route.reconcile_banking(bad, SPEC, CONTROL)[1].groupBy("rule_id").agg(F.count("*").alias("n")).collect()}
    assert rules == {"BANK-UNKNOWN-RECORD-TYPE": 1, "BANK-UNKNOWN-POLARITY": 1, "BANK-CONTROL-MISMATCH": 2}
    rules = [r["rule_id"] for r in route.reconcile_banking(file_of(spark, details), SPEC, CONTROL)[1].collect()]
    assert rules == ["BANK-NO-TRAILER"] * 3
    from dataclasses import replace

    totals, found = route.reconcile_banking(file_of(spark, details, (3, "99.50", "50.50")), SPEC, replace(CONTROL, roles={"AMT": "rate"}))
    assert "BANK-PROFILE-INCONSISTENT" in [r["rule_id"] for r in found.collect()] and [r["observed"] for r in totals.collect()][1:] == [None, None]
    assert {r["variant"]: r["records"] for r in route.variant_counts(bad, SPEC).collect()} == {"head": 1, "detail": 4, "trail": 1, "(unknown)": 1}


def test_chain_does_not_depend_on_partitions(spark):
    import hashlib

    raw = [bytes([i % 251] * 14) for i in range(500)]
    df = rows(spark, *raw)
    want = ""
    for r in raw:
        want = hashlib.sha256(want.encode() + r).hexdigest()
    for d in (df, df.repartition(7), df.coalesce(1)):
        assert custody.record_chain(d).first()["hash"] == want
    in_row = df.agg(F.transform(F.sort_array(F.collect_list(F.struct("record_index", "record"))), lambda x: x["record"]).alias("a")).select(custody.chain_in_row(F.col("a")).alias("h"))
    assert in_row.first()["h"] == want
    ranges = custody.record_chain(df.repartition(7), most=60).first()
    assert (ranges["hash"], ranges["records"]) == (want, 500)


def test_batch_chain(spark):
    b = spark.createDataFrame([(i, f"b{i}", f"i{i}", f"c{i}", f"o{i}") for i in range(4)], "batch_no long, batch_id string, input_hash string, control_hash string, output_hash string")
    sealed = custody.seal_chain(b)
    assert custody.verify_chain(sealed).first()["first_broken"] is None
    swapped = sealed.withColumn("batch_no", F.when(F.col("batch_no") == 1, 2).when(F.col("batch_no") == 2, 1).otherwise(F.col("batch_no")))
    assert custody.verify_chain(swapped).first()["first_broken"] == 1
    last = sealed.orderBy(F.desc("batch_no")).first()["link_hash"]
    more = custody.seal_chain(b.withColumn("batch_no", F.col("batch_no") + 4), before=last)
    assert custody.verify_chain(sealed.unionByName(more)).first()["first_broken"] is None


def test_posting(spark):
    layout = compile_layout("01 P.\n05 S PIC 9(6).\n05 X PIC X(8).\n")
    df = rows(spark, b"000001TXN1    ", b"000002TXN2    ", b"000002TXN3    ", b"000005TXN1    ", b"00000?TXN9    ")
    found = lambda c: sorted(r["rule_id"] for r in custody.posting_findings(df, layout, custody.PostingSpec("u", "S", "X", c)).collect())
    assert found(False) == ["POSTING-DIRTY-SEQUENCE", "POSTING-DUPLICATE-SEQUENCE", "POSTING-DUPLICATE-TXN-ID"]
    assert found(True) == sorted([*found(False), "POSTING-SEQUENCE-GAP"])
    gap = custody.sequence_gaps(spark.createDataFrame([(1,), (2,), (5,)], "s long"), "s").collect()
    assert [(r["first"], r["last"]) for r in gap] == [(3, 4)]
    assert custody.posting_findings(df, layout, custody.PostingSpec("u", "NONE")).first()["rule_id"] == "POSTING-NO-SEQUENCE"
    with pytest.raises(ValueError, match="id"):
        custody.posting_findings(df, layout, custody.PostingSpec("", "S"))


def test_profiles(spark):
    layout = compile_layout("01 R.\n05 D PIC 9(8).\n05 J PIC 9(5).\n05 A PIC S9(7)V99 COMP-3.\n05 I PIC S9(4) COMP-5.\n05 W PIC X(2).\n")
    rec = lambda d, j, i: d + j + b"\x00\x00\x12\x34\x5c" + i + b"  "
    df = rows(spark, rec(b"20240229", b"24366", b"\xff\xff"), rec(b"20230229", b"23366", b"\x00\x00"), rec(b"00000000", b"99999", b"\x07\x00"), rec(b"0000010A", b"00001", b"\x00\x00"))
    dates = profiles.date_validate(df, layout, (profiles.DateRule("D"), profiles.DateRule("J", "YYDDD", ("99999",)), profiles.DateRule("Q")))
    got = [(r["field"], r["status"]) for r in dates.orderBy("record_index", "field").collect()]
    assert [s for f, s in got if f == "D"] == ["valid", "invalid_calendar", "invalid_calendar", "invalid_format"]
    assert [s for f, s in got if f == "J"] == ["valid", "invalid_calendar", "declared_sentinel", "valid"]
    rules = lambda d: {r["rule_id"] for r in profiles.date_findings(d).collect()}
    assert rules(dates) == {"DATE-MISSING-FIELD", "DATE-INVALID-CALENDAR-DATE", "DATE-INVALID-FORMAT"}
    strict = profiles.date_validate(df, layout, (profiles.DateRule("D", require_sentinel=True), profiles.DateRule("A"))).orderBy("record_index", "field").collect()
    assert [list(r["rule_ids"]) for r in strict if r["field"] == "D"] == [[], *[["DATE-INVALID-CALENDAR-DATE", "DATE-SENTINEL-UNDECLARED"]] * 2, ["DATE-INVALID-FORMAT"]]
    assert all(list(r["rule_ids"]) == ["DATE-INVALID-FORMAT"] for r in strict if r["field"] == "A")  # packed bytes are no digits of text
    ind = profiles.null_indicators(df, layout, (profiles.Indicator("A", "I"), profiles.Indicator("A", "W"), profiles.Indicator("A", "NO"), profiles.Indicator("NO", "I")))
    first = ind.where("rule_id is null").orderBy("record_index").collect()
    assert [(r["status"], r["value"]) for r in first] == [("null", None), ("present", "123.45"), ("truncated", "123.45"), ("present", "123.45")]
    assert {r["rule_id"] for r in ind.collect()} == {None, "DB2-WRONG-INDICATOR-USAGE", "DB2-MISSING-INDICATOR", "DB2-MISSING-VALUE-FIELD"}
    cur = profiles.currency_validate(df, layout, (profiles.CurrencyRule("A", "amount", 2, "W"), profiles.CurrencyRule("A", "amount", 3, "NO"), profiles.CurrencyRule("A", "amount", 3, scale_is_finding=False), profiles.CurrencyRule("A", "rate", 2), profiles.CurrencyRule("Z", "amount", 2)))
    got = [(r["field"], r["observed_scale"], r["code"], list(r["rule_ids"])) for r in cur.where("record_index = 0").collect()]
    assert got == [("A", 2, "", []), ("A", 2, None, ["CURRENCY-SCALE-MISMATCH", "CURRENCY-MISSING-CODE"]), ("A", 2, None, []), ("A", None, None, ["CURRENCY-ROLE-NOT-AMOUNT"]), ("Z", None, None, ["CURRENCY-MISSING-FIELD"])]
    hits = profiles.sentinel_scan(df, layout, (profiles.Sentinel("D", "none", value="0"), profiles.Sentinel("I", "gone", raw_hex="FFFF")))
    assert {(r["record_index"], r["meaning"]) for r in hits.collect()} == {(2, "none"), (0, "gone")}


def test_redaction(spark):
    layout = compile_layout("01 R.\n05 ID PIC 9(6).\n05 N PIC X(4).\n05 Q PIC 9(3).\n")
    df = rows(spark, b"000123ANNA007")
    r = {x["field"]: x for x in profiles.redact(df, layout, profiles.Redaction("pilot", {"ID": "token", "N": "hash"})).collect()}
    assert r["ID"]["value"].startswith("TOK-") and len(r["ID"]["value"]) == 16 and r["N"]["value"] is None and r["N"]["raw_hex"] is None and r["Q"]["rule_id"] == "PRIVACY-UNLISTED-FIELD"
    assert all(r[f]["value_sha256"] and r[f]["raw_sha256"] and r[f]["redacted"] for f in r)
    kept = {x["field"]: x for x in profiles.redact(df, layout, profiles.Redaction("pilot", {"ID": "allow", "N": "hash_only"}, keep_raw=True)).collect()}
    assert (kept["Q"]["action"], kept["Q"]["raw_hex"], kept["N"]["raw_hex"], kept["ID"]["redacted"]) == ("hash", "303037", None, False) and kept["ID"]["value_sha256"]
    t = spark.range(1).select(profiles.token(F.lit("ACCT0001"), "pilot").alias("t")).first()["t"]
    assert t == "TOK-5bea7a2f914e"


def test_pilot_and_leaks(spark):
    df = file_of(spark, [("D", "100.00"), ("C", "50.50")], (2, "100.00", "50.50"))
    pilot = Pilot("u1", SPEC, CONTROL, custody.PostingSpec("u1", "ID"), profiles.Redaction("s", {"T": "allow", "P": "allow", "AMT": "allow", "RATE": "allow", "ID": "token", "MEMO": "hash"}))
    out = run_pilot(df, pilot)
    assert json.loads(out.texts["casefile"])["balanced"] and json.loads(out.texts["packet"])["complete"]
    assert out.rows["redaction"].count() == 12 and json.loads(out.texts["packet"])["rows"]["redaction"]["records"] == 12
    # a clear value of a record far behind the first thousand is found, too
    far = df.union(file_of(spark, [("Zebra", "1.00")]).where("record_index = 1").withColumn("record_index", F.lit(5000).cast("long")))
    assert leaks(far, Evidence({"report": "about memo"}, {}), pilot) == ["report"]
    from dataclasses import replace

    with pytest.raises(LeakError):
        run_pilot(df, replace(pilot, unit="memo-unit", posting=custody.PostingSpec("memo-unit", "ID")))


def test_diff(spark):
    layout = compile_layout("01 R.\n05 A PIC 9(3).\n05 B PIC X(4).\n")
    a, b = decode_long(rows(spark, b"042ANNA"), layout), decode_long(rows(spark, b"043ANNA"), layout)
    rules = lambda *x: [r["rule_id"] for r in views.diff_artifacts(*x).collect()]
    one, other = views.Artifacts(fields=a, hashes={"x": "1"}), views.Artifacts(fields=b, hashes={"x": "2", "y": "3"})
    assert rules(one, other) == rules(one, other, views.Target(views.ORACLE)) == ["DIFF-FIELD-MISMATCH", "DIFF-HASH-MISMATCH", "DIFF-HASH-MISMATCH"]
    assert rules(one, other, views.Target(allowed=("field_values",))) == ["DIFF-FIELD-MISMATCH"]
    assert rules(one, other, views.Target(allowed=("control_totals",))) == ["DIFF-TARGET-NOT-ORACLE"]
    assert rules(one, one) == ["DIFF-TARGET-NOT-ORACLE"] and rules(one, one, views.Target(views.ORACLE)) == []
    with pytest.raises(ValueError, match="unknown"):
        views.Target("trusted")


def test_fixture_needs_non_claims_unless_it_passes(spark):
    none = spark.createDataFrame([], "rule_id string")
    assert views.replay_fixture(views.Fixture("a", "pass", frozenset()), "pass", none).count() == 0
    assert [r["rule_id"] for r in views.replay_fixture(views.Fixture("a", "refused", frozenset()), "refused", none).collect()] == ["FIXTURE-NON-CLAIM-REQUIRED"]
    assert views.replay_fixture(views.Fixture("a", "refused", frozenset(), ("meaning",)), "refused", none).count() == 0


def test_stages_are_timed(spark):
    df = rows(spark, b"042ANNA", b"043BOB ").withColumns({"raw_offset": F.col("record_index") * 7, "raw_len": F.lit(7)})
    made, seconds = recon.reconcile_profile(df, "01 R.\n05 A PIC 9(3).\n05 B PIC X(4).\n", "two")
    assert list(seconds) == ["parse", "record", "aggregate"] and all(s > 0 for s in seconds.values()) and made.receipt.first()["record_count"] == 2


def test_a_folder_of_files_is_numbered_through(spark, tmp_path):
    for name, data in (("b.dat", b"33"), ("a.dat", b"1122"), ("_half", b"9"), ("c.dat", b"")):
        (tmp_path / name).write_bytes(data)
    df = read_records(spark, str(tmp_path), Policy(2), split_bytes=2)
    assert [(r["record_index"], r["raw_offset"], bytes(r["record"])) for r in df.orderBy("record_index").collect()] == [(0, 0, b"11"), (1, 2, b"22"), (2, 0, b"33")]
    assert [bytes(r["record"]) for r in df.where("record_index >= 1 and record_index < 3").orderBy("record_index").collect()] == [b"22", b"33"]
    assert df.where("record_index = 7").count() == 0
    (tmp_path / "b.dat").write_bytes(b"3")
    with pytest.raises(IngestError):
        read_records(spark, str(tmp_path), Policy(2))


def test_stream_of_files(spark, tmp_path):
    from recordloom.streaming.arrivals import record_stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.dat").write_bytes(b"042ANNA043BOB ")
    layout = compile_layout("01 R.\n05 A PIC 9(3).\n05 B PIC X(4).\n")
    q = decode(record_stream(spark, str(folder), 7), layout).writeStream.format("memory").queryName("arrivals").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((int(r["A"]), r["B"]) for r in spark.table("arrivals").collect()) == [(42, "ANNA"), (43, "BOB")]


def test_cli(spark, tmp_path, capsys):
    from recordloom.cli import main

    (tmp_path / "c.cpy").write_text("01 R.\n05 A PIC 9(3).\n05 B PIC X(4).\n")
    (tmp_path / "d.dat").write_bytes(b"042ANNA04?BOB ")
    args = ["--data", str(tmp_path / "d.dat"), "--copybook", str(tmp_path / "c.cpy")]
    assert main(["dump", *args, "--record", "0"], spark) == 0 and "ANNA" in capsys.readouterr().out
    assert main(["decode", *args], spark) == 1 and main(["decode", *args, "--dirty-mode", "strict"], spark) == 2
    assert main(["ingest", "--data", str(tmp_path / "d.dat"), "--record-len", "5"], spark) == 2
    assert main(["pilot", "--out", str(tmp_path / "packet"), "--notes", "n"], spark) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["complete"]
    assert (tmp_path / "packet" / "casefile.txt").exists() and not any("ACCT0001" in p.read_text() for p in (tmp_path / "packet").rglob("*") if p.is_file() and p.suffix in (".txt", ".json"))
    assert main(["reconcile", *args], spark) == 0 and main(["explain", *args, "--field", "NONE"], spark) == 4
