"""Nested records, record types in one pass, arriving files, sequence sets and key ranges, on small fixtures made by hand."""

import random
from decimal import Decimal

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from recordloom.functions.decode import CP500, decode_long
from recordloom.functions.nested import count_findings, decode_nested, nested_schema
from recordloom.operators import custody, route, views
from recordloom.plans.copybook import CopybookError, compile_layout
from recordloom.sources.fixedrec import Policy, read_records
from recordloom.streaming.arrivals import record_stream


def rows(spark, *records):
    return spark.createDataFrame([(i, bytes(r)) for i, r in enumerate(records)], "record_index long, record binary")


TREE = compile_layout("""
    01 R.
       05 A       PIC X(2).
       05 N       PIC 9.
       05 G       OCCURS 1 TO 3 TIMES DEPENDING ON N.
          10 M    PIC 9.
          10 V    PIC 9(2) OCCURS 0 TO 2 DEPENDING ON M.
             88 BIG VALUE 50 THRU 99.
          10 S    PIC S9(2) COMP-3.
       05 T       PIC 9 OCCURS 2.
""")


def test_arrays_have_their_declared_length(spark):
    full = b"k1" + b"2" + b"25099\x01\x2c" + b"1077x\x03\x4d" + b"\xff" * 7 + b"78"
    r = decode_nested(rows(spark, full), TREE).first()
    assert [tuple(x) for x in r["G"]] == [(1 + 1, [50, 99], [True, True], 12), (1, [7], [False], -34)]
    assert r["T"] == [7, 8] and r["A"] == "k1" and TREE.record_len == len(full)


def test_counts_out_of_bounds_are_told(spark):
    g = b"10011\x01\x2c"
    bad = [b"k1" + n + g * 3 + b"78" for n in (b"0", b"4", b"?", b"3")]
    inner = b"k1" + b"2" + g + b"9" + g[1:] + g + b"78"
    df = rows(spark, *bad, inner, b"k1")
    got = {r["record_index"]: r["G"] for r in decode_nested(df, TREE).collect()}
    assert got[0] is got[1] is got[2] is got[5] is None and len(got[3]) == 3
    assert got[4][0]["V"] == [0] and got[4][1]["V"] is None and got[4][1]["S"] == 12
    said = {(r["record_index"], r["rule_id"], r["message"]) for r in count_findings(df, TREE).collect()}
    assert said == {
        (0, "ODO-COUNT-OUT-OF-RANGE", "G: N is 0, not 1 to 3"), (1, "ODO-COUNT-OUT-OF-RANGE", "G: N is 4, not 1 to 3"), (2, "ODO-COUNT-DIRTY", "G: N is no valid number, not 1 to 3"),
        (4, "ODO-COUNT-OUT-OF-RANGE", "G(2).V: M is 9, not 0 to 2"), (5, "ODO-COUNT-DIRTY", "G: N is no valid number, not 1 to 3"),
    }


def test_nested_forms(spark):
    layout = compile_layout("01 R.\n05 K PIC X(4).\n05 FILLER REDEFINES K.\n10 K1 PIC X.\n88 IS-A VALUE 'a'.\n10 K2 PIC X(3).\n05 P OCCURS 2.\n10 Q.\n15 X PIC X.\n10 FILLER PIC X.\n10 Y PIC X.\n05 O.\n10 X PIC 9.\n")
    df = rows(spark, b"abcdx-yX-Y5", b"")
    assert [f.name for f in nested_schema(df, layout).fields] == ["K", "K1", "IS-A", "K2", "P", "O"]
    r, short = decode_nested(df, layout).orderBy("record_index").collect()
    assert (r["K"], r["K1"], r["IS-A"], r["K2"]) == ("abcd", "a", True, "bcd") and [(p["Q"]["X"], p["Y"]) for p in r["P"]] == [("x", "y"), ("X", "Y")] and r["O"]["X"] == 5
    assert short["K"] is None and [p["Y"] for p in short["P"]] == [None, None] and short["O"]["X"] is None
    assert count_findings(df, layout).count() == 0
    ebcdic = rows(spark, "abcdx-yX-Y5".encode("cp500"))
    assert decode_nested(ebcdic, layout, CP500).first()["P"][1]["Y"] == "Y"
    with pytest.raises(CopybookError):
        decode_nested(df, compile_layout("01 R.\n05 A PIC X.\n05 A PIC X.\n"))
    for text in ("01 R.\n05 B PIC X OCCURS 1 TO 2 DEPENDING ON N.\n05 N PIC 9.\n", "01 R.\n05 N PIC 9.\n05 B PIC X OCCURS 3 TO 2 DEPENDING ON N.\n"):
        with pytest.raises(CopybookError):
            compile_layout(text)
    with pytest.raises(CopybookError):
        decode_nested(df, compile_layout("01 R.\n05 N PIC X.\n05 B PIC X OCCURS 1 TO 2 DEPENDING ON N.\n"))


def test_unused_arrays_are_not_made(spark):
    plan = decode_nested(rows(spark, b""), TREE).select("A")._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan


def test_variants_in_one_scan(spark, tmp_path):
    a, b = compile_layout("01 A.\n05 AT PIC X.\n05 AN PIC 9(2).\n"), compile_layout("01 B.\n05 BT PIC X.\n05 BX PIC X(2).\n")
    spec = route.VariantSpec(0, 1, (route.Variant("num", b"N", a), route.Variant("text", b"T", b)))
    rows(spark, b"N12", b"Tab", b"?zz", b"Nxx", b"").write.parquet(f"{tmp_path}/r")
    df = route.decode_variants(spark.read.parquet(f"{tmp_path}/r"), spec)
    got = [(r["variant"], r["fields"]["num"] and r["fields"]["num"]["AN"], r["fields"]["text"] and r["fields"]["text"]["BX"]) for r in df.orderBy("record_index").collect()]
    assert got == [("num", Decimal(12), None), ("text", None, "ab"), (None, None, None), ("num", None, None), (None, None, None)]
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def streamed(spark, folder, out, state, **kind):
    q = record_stream(spark, str(folder), Policy(4, **{k: v for k, v in kind.items() if k in ("partial", "newline")}), growing=kind.get("growing", "last"), split_bytes=8)
    q.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.schema("record_index long, raw_offset long, raw_len int, partial boolean, record binary").parquet(str(out)).collect()))


def test_stream_goes_on_after_a_restart_and_equals_a_batch(spark, tmp_path):
    folder, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    folder.mkdir()
    out.mkdir()
    assert streamed(spark, folder, out, state, partial="evidence") == []
    (folder / "a").write_bytes(b"aaa1aaa2aaa3aaa4aaa5aa")
    (folder / "_hidden").write_bytes(b"no")
    assert len(streamed(spark, folder, out, state, partial="evidence")) == 5  # the file may still grow
    (folder / "a").write_bytes(b"aaa1aaa2aaa3aaa4aaa5aaa6aaa7a")
    assert len(streamed(spark, folder, out, state, partial="evidence")) == 7
    (folder / "b").write_bytes(b"bbb1")
    (folder / "c").write_bytes(b"")
    (folder / "d").write_bytes(b"ddd1ddd2")
    got = streamed(spark, folder, out, state, partial="evidence")
    batch = sorted(map(tuple, read_records(spark, str(folder), Policy(4, partial="evidence"), split_bytes=8).collect()))
    assert got == batch and len(got) == 11 and got[7][3] and bytes(got[7][4]) == b"a"


def test_stream_of_whole_files_takes_the_tail_at_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    folder.mkdir()
    (folder / "a").write_bytes(b"aaa1\n")
    assert len(streamed(spark, folder, out, state, growing="none", newline="allow")) == 1
    (folder / "b").write_bytes(b"bbb1")
    assert [r[0] for r in streamed(spark, folder, out, state, growing="none", newline="allow")] == [0, 1]


@pytest.mark.parametrize("change", ["late", "shrunk", "gone", "grown"])
def test_stream_stops_where_the_past_changes(spark, tmp_path, change):
    folder, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    folder.mkdir()
    for name in "bd":
        (folder / name).write_bytes(b"xxx1xxx2")
    streamed(spark, folder, out, state)
    if change == "late":
        (folder / "a").write_bytes(b"xxx0")
    elif change == "shrunk":
        (folder / "d").write_bytes(b"xxx1")
    elif change == "gone":
        (folder / "d").unlink()
    else:
        (folder / "b").write_bytes(b"xxx1xxx2xxx3")
    (folder / "e").write_bytes(b"xxx9")
    with pytest.raises(StreamingQueryException, match="changed or arrived late|shrank|is gone"):
        streamed(spark, folder, out, state)


def test_sequence_sets_equal_brute_force(spark):
    rng = random.Random(4)
    values = [rng.randint(-200_000, 200_000) for _ in range(3000)] + list(range(40_000, 75_000)) + [-(2**63), 2**63 - 1, 2**40, 0, 0, None]
    values += [7] * 2000
    df = spark.createDataFrame([(v,) for v in values], "v long")
    seen = sorted({v for v in values if v is not None})
    gaps = {(a + 1, b - 1) for a, b in zip(seen, seen[1:], strict=False) if b > a + 1}
    assert {tuple(r) for r in custody.sequence_gaps(df, "v").collect()} == gaps
    counts = {v: values.count(v) for v in {7, 0, *values[:3000]} if values.count(v) > 1}
    assert {tuple(r) for r in custody.sequence_duplicates(df, "v").collect()} == set(counts.items())
    none = df.where("v is null")
    assert custody.sequence_gaps(none, "v").count() == custody.sequence_duplicates(none, "v").count() == 0


def test_dense_sequences_shrink_before_the_shuffle(spark):
    words = custody.sequence_words(spark.range(1_000_000).repartition(4), "id")
    assert words.count() == 1_000_000 // 64 and "HashAggregate" in (p := words._jdf.queryExecution().executedPlan().toString()) and "Sort" not in p


def long_of(spark, values):
    return spark.createDataFrame(values, "record_index long, name string, value string")


def test_ranges_find_what_the_whole_join_finds(spark):
    base = [(k, n, f"{k}{n}") for k in range(-50, 400) for n in "AB"]
    other = [r for r in base if r[0] not in (7, 8)] + [(9, "C", "new"), (399, "A", None)]
    other = [(k, n, "changed" if (k, n) == (200, "B") else v) for k, n, v in other if (k, n, v) != (399, "A", "399A")] + [(None, "A", "x")]
    a, b = long_of(spark, base), long_of(spark, other)
    want = sorted(map(str, views.diff_fields(a, b).collect()))
    assert sorted(map(str, views.diff_ranges(a, b, width=8).collect())) == want and len(want) == 8
    trees = views.digest_tree(a, width=8), None
    assert sorted(map(str, views.diff_ranges(a, b, width=8, trees=trees).collect())) == want


def test_equal_ranges_do_not_reach_the_join(spark):
    a = long_of(spark, [(k, "A", str(k)) for k in range(2000)])
    b = a.withColumn("value", F.when(F.col("record_index") == 1234, "x").otherwise(F.col("value")))
    leaves = views.differing_leaves(views.digest_tree(a, width=10), views.digest_tree(b, width=10), fan_out=16).checkpoint()
    assert [r["leaf"] for r in leaves.collect()] == [123]
    assert views.in_leaves(a, leaves, "record_index", 10).count() == 10
    assert views.diff_ranges(a, a.repartition(7), width=10).count() == 0
    twice = a.union(a)  # an even number of equal rows doesn't cancel
    assert views.differing_leaves(views.digest_tree(a, width=1000), views.digest_tree(twice, width=1000)).count() == 2
    assert views.diff_ranges(a.limit(0), a.limit(0)).count() == 0


def test_ranges_over_decoded_records(spark):
    layout = compile_layout("01 R.\n05 A PIC 9(3).\n05 B PIC X(2).\n")
    a = rows(spark, *(b"%03dxx" % i for i in range(30)))
    b = rows(spark, *(b"%03dx%s" % (i, b"y" if i == 17 else b"x") for i in range(30)))
    got = views.diff_ranges(decode_long(a, layout), decode_long(b, layout), width=4).collect()
    assert [(r["record_index"], r["name"], r["left"], r["right"]) for r in got] == [(17, "B", "xx", "xy")]
