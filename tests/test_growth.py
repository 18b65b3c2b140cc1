"""Steps that must not join, order or split by chance or by a table's size."""

from pyspark.sql import functions as F

from recordloom import queries as q
from recordloom.functions.encode import encode_edited, encode_field
from recordloom.operators import recon, route
from recordloom.plans.copybook import compile_layout
from recordloom.sources.fixedrec import MOST_RANGES, Policy, read_records

PAIR = compile_layout("01 R.\n05 A PIC 9(2).\n05 B PIC X.\n   88 ON VALUE \"Y\".\n05 C PIC S9(3)V99 COMP-3.\n")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_delta_pairs_the_fields_of_a_row(spark):
    records = [(1, b"07N\x01\x23\x4d"), (2, b"08Y\x01\x23\x4d"), (3, b"0"), (1, b"09 \x01\x23\x4d")]
    df = spark.createDataFrame(records, "record_index long, record binary")
    out, _ = recon.transform(df, PAIR, recon.Transform("set_true", "ON"))
    delta = recon.transform_delta(out, PAIR)
    assert "Join" not in plan(delta)
    assert sorted(map(tuple, delta.collect())) == [(1, "B", "", "Y"), (1, "B", "N", "Y")]


def test_lines_of_equal_numbers_have_one_order(spark, tmp_path):
    made = [(i % 7, i % 7, 6, b"%02dY\x01\x23\x4d" % (i * 37 % 100)) for i in range(200)]
    df = spark.createDataFrame(made, "record_index long, raw_offset long, raw_len int, record binary").repartition(5)
    done = recon.reconcile_pass(df, PAIR.text, f"file://{tmp_path}/lines")
    other = recon.ordered_digest(recon.record_json(df.repartition(3), PAIR), "record_index", "line").first()
    assert (done.output_sha256, done.records) == (other["hash"], other["records"])
    assert done.totals.where("name = 'A'").first()["total"] == str(sum(i * 37 % 100 for i in range(200)))


def test_edited_pictures_by_groups(spark):
    f = compile_layout("01 R.\n05 A PIC ZZZ,ZZ9.99CR.\n05 B PIC -Z,ZZZ.\n05 C PIC 9,9Z.Z.\n").elementary()
    values = spark.sql("SELECT * FROM VALUES (0.00BD), (0.05BD), (-12.34BD), (999.99BD), (1000.00BD), (-123456.78BD), (1234567.00BD), (null) AS t(v)")
    got = values.select(*(F.decode(encode_edited(F.col("v"), x), "US-ASCII").alias(x.name) for x in f)).collect()
    assert [r["A"] for r in got] == ["      0.00  ", "      0.05  ", "     12.34CR", "    999.99  ", "  1,000.00  ", "123,456.78CR", None, None]
    assert [r["B"] for r in got] == ["      ", "      ", "-   12", "   999", " 1,000", None, None, None]
    assert [r["C"] for r in got] == ["0,00.0", "0,00.0", "0,12.3", "9,99.9", None, None, None, None]
    tree = encode_edited(F.col("v"), f[0])
    assert str(tree).count("v AS DECIMAL") < 10 and plan(values.select(tree.alias("x"))).count("floor") < 3  # 80 and more, when each place named all digits


def test_ranges_grow_and_not_their_number(spark, tmp_path):
    n, total = 50, 200_000
    data = b"".join(b"%050d" % i for i in range(total))
    (tmp_path / "a.dat").write_bytes(data[: 70_001 * n])
    (tmp_path / "b.dat").write_bytes(data[70_001 * n :] + b"cut")
    df = read_records(spark, str(tmp_path), Policy(n, partial="evidence"), split_bytes=10 * n)
    assert df.rdd.getNumPartitions() <= MOST_RANGES + 2  # 20,001, when a range had always ten records
    told = df.where("not partial").agg(F.count("*"), F.sum("record_index"), F.count_if(F.decode("record", "US-ASCII").cast("long") == F.col("record_index")), F.max("raw_offset")).first()
    assert tuple(told) == (total, total * (total - 1) // 2, total, (total - 70_001 - 1) * n)
    assert [(r["record_index"], r["raw_len"], bytes(r["record"])) for r in df.where("partial").collect()] == [(total, 3, b"cut")]
    few = read_records(spark, str(tmp_path), Policy(n, partial="evidence"), split_bytes=10 * n, first=69_999, last=70_004)
    assert [r["record_index"] for r in few.orderBy("record_index").collect()] == list(range(69_999, 70_005))


def test_numbers_are_encoded_by_their_own_type(spark):
    """Longs and short decimals of the picture's scale don't go through decimals of 38 digits; their bytes are those of wide ones."""
    layout = compile_layout("01 R.\n05 A PIC 9(5).\n05 B PIC S9(3)V99 COMP-3.\n05 C PIC Z,ZZ9.99CR.\n05 D PIC S9(18).\n05 E PIC ZZ9,999.\n")
    rows = [(0, "0"), (7, "-0.05"), (-3, "12.34"), (99999, "-999.99"), (100000, "1000.00"), (-100000, "-1000.00"), (2**62, "99999.99"), (-(2**63), "0.10"), (None, None)]
    df = spark.createDataFrame(rows, "i long, m string").select("i", F.col("m").cast("decimal(18,2)").alias("m"))
    for name, c, kind in (("A", "i", "i"), ("D", "i", "i"), ("E", "i", "i"), ("B", "m", "m"), ("C", "m", "m")):
        f = layout.field(name)
        made = df.select(encode_field(F.col(c), f).alias("x"), encode_field(F.col(c).cast("decimal(38,10)"), f).alias("y"))
        assert "38" not in plan(made.select("x")) and "typeof" not in plan(made), name
        assert all(r["x"] == r["y"] for r in made.collect()), name
    shown = df.where("i = 7").select(encode_field(F.col("m"), layout.field("C")).alias("x"), encode_field(F.col("i"), layout.field("E")).alias("y")).first()
    assert (bytes(shown["x"]), bytes(shown["y"])) == (b"    0.05CR", b"  0,007")


def test_rows_of_one_group_are_dealt_out(spark, tmp_path):
    """A file of one group of rows is read by one task; what follows has more."""
    n = 3 * q.LEAST_TASK_ROWS
    made = spark.range(n).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit(1.5).alias("c_acctbal"), F.lit("s").alias("c_mktsegment"))
    made.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = q.customers(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 3
    assert rows.groupBy("record_index").count().where("count = 1").count() == n


def test_banking_reads_its_records_once(spark):
    seen = spark.sparkContext.accumulator(0)
    detail, trailer = compile_layout("01 D.\n05 T PIC X.\n05 M PIC S9(3)V99 COMP-3.\n05 P PIC X.\n"), compile_layout("01 E.\n05 T PIC X.\n05 N PIC 9.\n05 S PIC S9V99 COMP-3.\n05 C PIC 9.\n")
    records = [(1, b"D\x00\x10\x0cR"), (2, b"D\x00\x10\x0cX"), (3, b"D\xff\xff\xffR"), (4, b"?00000")]

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(records, "record_index long, record binary").mapInArrow(count, "record_index long, record binary")
    spec = route.VariantSpec(0, 1, (route.Variant("d", b"D", detail), route.Variant("t", b"T", trailer)))
    totals, found = route.reconcile_banking(df, spec, route.Control("d", "t", "M", "P", ("R",), ("N",), "N", "S", "S", {"M": "amount"}))
    assert [tuple(r) for r in totals.select("measure", F.col("observed").cast("string")).orderBy("measure").collect()] == [("credit_total", "0.00"), ("debit_total", "1.00"), ("record_count", "3.00")]
    assert sorted(r["rule_id"] for r in found.collect()) == ["BANK-DIRTY-DETAIL", *["BANK-NO-TRAILER"] * 3, "BANK-UNKNOWN-POLARITY", "BANK-UNKNOWN-RECORD-TYPE"]
    assert seen.value == len(records)
