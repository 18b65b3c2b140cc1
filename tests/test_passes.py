"""Passes over records: what is decoded once, digests and chains of whole lines, and records that lie in ranges already."""

import hashlib

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from recordloom import queries as q
from recordloom import record_queries
from recordloom.functions.decode import number, right_trim
from recordloom.operators import custody, recon
from recordloom.plans.copybook import compile_layout

PAIR = compile_layout("01 R.\n05 A PIC 9(2).\n05 B PIC X.\n   88 ON VALUE \"Y\".\n05 C PIC S9(3)V99 COMP-3.\n")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_pass_decodes_each_field_once(spark, tmp_path):
    """Lines and totals come from one decoding; the digests of two foldersful of lines are two tasks of one stage."""
    df = spark.createDataFrame([(i, i * 6, 6, b"%02dY\x01\x23\x4d" % i) for i in range(90)] + [(90, 540, 1, b"9")], "record_index long, raw_offset long, raw_len int, record binary")
    seen = Observation()
    made = recon._lines(recon._decoded(df, PAIR, "ascii").observe(seen, *recon._decoded_aggs(PAIR)), PAIR)
    assert plan(made).count("try_cast") == plan(recon.record_json(df, PAIR)).count("try_cast") == 2
    done = recon.reconcile_pass(df, PAIR.text, f"file://{tmp_path}/lines")
    assert sorted(map(str, done.totals.collect())) == sorted(map(str, recon.control_totals(df, PAIR).collect()))
    both = recon.ordered_digest(done.lines, "record_index", "line").union(done.output)
    assert both.rdd.getNumPartitions() == 2 and both.distinct().count() == 1
    assert done.output_sha256 == both.first()["hash"] and done.records == 91


def test_a_pass_takes_records_that_lie_in_ranges(spark, tmp_path):
    """Given ranges aren't shuffled again, and partitions that are no such ranges are refused; either way the results are those of any order."""
    df = spark.createDataFrame([(i // 2, i, 6, b"%02dY\x01\x23\x4d" % (i * 37 % 100)) for i in range(200)], "record_index long, raw_offset long, raw_len int, record binary")
    want = recon.reconcile_pass(df.repartition(5), PAIR.text, f"file://{tmp_path}/any")
    for name, made in (("few", {"ranges": 7}), ("placed", {"placed": True})):
        got = recon.reconcile_pass(df.repartitionByRange(6, "record_index"), PAIR.text, f"file://{tmp_path}/{name}", **made)
        assert (got.output_sha256, got.records) == (want.output_sha256, 200)
        assert sorted(map(str, got.totals.collect())) == sorted(map(str, want.totals.collect()))
        assert len(list((tmp_path / name).glob("part-*"))) == (6 if "placed" in made else 7)
    for name, mixed in (("dealt", df.repartition(4)), ("parted", df.withColumn("h", (F.col("raw_offset") > 100).cast("int")).repartitionByRange(2, "h"))):  # the second parts 100 from 101, which have one number
        with pytest.raises(ValueError, match="don't begin beyond"):
            recon.reconcile_pass(mixed, PAIR.text, f"file://{tmp_path}/{name}", placed=True)
    assert recon.reconcile_pass(df.limit(0), PAIR.text, f"file://{tmp_path}/none", placed=True).records == 0


def test_digests_read_texts_as_they_lie(spark):
    """Nulls are empty texts, and those with line feeds or beyond ASCII keep their bytes; no other column is read."""
    texts = ["b", None, "", "two\nlines", "\u00e4\U0001f600", "a" * 70_000] * 2000
    df = spark.createDataFrame(list(enumerate(texts)), "o long, t string").withColumn("z", F.array("o"))
    files = custody.ordered_files(df.repartition(6), "o", 5)
    want = hashlib.sha256("".join(f"{t or ''}\n" for t in texts).encode()).hexdigest()
    assert tuple(custody.file_digest(spark, files, "t").first()) == (want, len(texts))
    assert {b.schema.names[0] for b in custody.file_batches(files, ["t"])} == {"t"} and sum(b.num_columns * b.num_rows for b in custody.file_batches(files, ["t"])) == len(texts)
    assert tuple(custody.ordered_digest(df.limit(0), "o", "t").first()) == (hashlib.sha256(b"").hexdigest(), 0)


def test_line_chain_is_of_whole_lines(spark, tmp_path):
    """Chain and digest tell every byte of every line, as a plain loop over the sorted lines does; lines of equal numbers among them."""

    def told(prices, name):
        made = [(i % 90, i % 7 + 1, float(i % 50), p, "RAN"[i % 3]) for i, p in enumerate(prices)]
        spark.createDataFrame(made, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        lines = [r[1] for r in sorted((r["record_index"], bytes(r["record"])) for r in q.lines(spark, f"{tmp_path}/{name}").collect())]
        state = ""
        for r in lines:
            state = hashlib.sha256(state.encode() + r).hexdigest()
        got = {r["kind"]: (r["records"], r["hash"]) for r in record_queries.line_chain(spark, f"{tmp_path}/{name}").collect()}
        assert got == {"chain": (len(lines), state), "digest": (len(lines), hashlib.sha256(b"".join(r + b"\n" for r in lines)).hexdigest())}
        return got

    prices = [100.25 + i for i in range(1300)]
    a, b = told(prices, "a"), told([*prices[:700], 5.0, *prices[701:]], "b")
    assert a["chain"] != b["chain"] and a["digest"] != b["digest"]
    assert told([], "none") == {"chain": (0, ""), "digest": (0, hashlib.sha256(b"").hexdigest())}


def test_edited_numbers_look_for_their_own_marks_alone(spark):
    cases = [("ZZ9.99CR", b" 12.34CR", "-12.34", 1), ("ZZ9.99CR", b" 12.34  ", "12.34", 1), ("ZZ9DB", b"  7DB", "-7", 1), ("-ZZ9.9", b"-  0.5", "-0.5", 1), ("+Z,ZZ9", b"+1,234", "1234", 1), ("+ZZ9", b"-  1", "-1", 1), ("ZZ9", b" 12", "12", 0), ("ZZZ", b"   ", None, 0), ("ZZ9", b"-12", None, 0)]
    for pic, raw, want, marks in cases:
        f = compile_layout(f"01 R.\n05 A PIC {pic}.\n").field("A")
        got = spark.createDataFrame([(raw,)], "record binary").select(number(f).cast("string").alias("n"))
        assert got.first()["n"] == want, (pic, raw)
        assert plan(spark.range(3).select(F.encode(F.col("id").cast("string"), "US-ASCII").alias("record")).select(number(f).alias("n"))).lower().count("contains(") == marks, pic
    ends = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    rows = [(t + e, t) for t in ("", "a", " b\u3000c", "\u200b", "\x1f") for e in ("", *ends, ends)]
    trimmed = spark.createDataFrame(rows, "t string, want string").select("want", right_trim(F.col("t")).alias("got"))
    assert all(r["got"] == r["want"] for r in trimmed.collect()) and "regexp" not in plan(trimmed)
