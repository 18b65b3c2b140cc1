"""Tables declared by copybooks: equal to the column expressions on any bytes, uses that don't narrow each other, pruned plans."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recordloom.functions.decode import ASCII, CP500
from recordloom.plans.copybook import compile_layout
from recordloom.sources import copybook_table
from recordloom.sources.fixedrec import Policy, read_records

EVERY = """
01 R.
05 A PIC X(3).
88 A-IS VALUE 'ab' 'c'.
88 A-TO VALUE 'b' THRU 'd'.
05 D PIC 9(2)V9.
88 D-LOW VALUE 0 THRU 9.5.
05 S PIC S9(3).
05 L PIC S9(2) SIGN LEADING.
05 P PIC S9(2) SIGN TRAILING SEPARATE.
05 Q PIC S9(2) SIGN LEADING SEPARATE.
05 C PIC S9(3)V99 COMP-3.
05 W PIC S9(20)V99 COMP-3.
05 V PIC 9(3) COMP-6.
05 B PIC S9(4) COMP.
05 B8 PIC 9(18) COMP.
05 C5 PIC S9(9)V99 COMP-5.
05 N8 PIC S9(18) COMP-5.
05 X3 PIC 9(6) COMP-X.
05 E PIC ZZ9.99CR.
05 U PIC 9(3) COMP-1.
05 T OCCURS 2.
10 G PIC X.
05 FILLER PIC X.
"""


def random_records(layout, n, seed):
    """Bytes that are often valid: digits, signs, nibbles, text, spaces, and any byte at times."""
    rng = random.Random(seed)
    pools = [b"0123456789", b"\x00\x12\x34\x56\x78\x90\x0c\x1d\x9c\x2f\x4a", b"abc \t\xc3\xa9\xff", b"+-pqrst{}", bytes(range(256)), b"\xf0\xf1\xf9\xc3\xd4\xe5\x4e\x60\x40\xc1\x81"]
    out = []
    for _ in range(n):
        record = b"".join(bytes(rng.choice(pool) for _ in range(f.size)) for f in layout.elementary() for pool in [rng.choice(pools)])
        f = layout.field("E")
        if rng.random() < 0.7:
            record = record[: f.offset] + rng.choice([b"  1.50CR", b"123.45  ", b"  0.00  ", b"   .  CR", b" 12.3 CR"]) + record[f.offset + f.size :]
        out.append(record)
    return out


def using(spark, path, text, **options):
    copybook_table.register(spark)
    given = ", ".join(f"{k} '{v}'" for k, v in {"path": path, "copybook": text.replace("'", '"'), **options}.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW t USING copybook OPTIONS ({given})")


@pytest.mark.parametrize("encoding", [ASCII, CP500])
def test_table_equals_expressions_on_any_bytes(spark, tmp_path, encoding):
    layout = compile_layout(EVERY)
    (tmp_path / "r").write_bytes(b"".join(random_records(layout, 1500, 6)) + b"abc123")
    using(spark, tmp_path / "r", EVERY, encoding=encoding, partial="evidence", split_bytes=100 * layout.record_len)
    table = spark.table("t")
    want = copybook_table.copybook_frame(read_records(spark, str(tmp_path / "r"), Policy(layout.record_len, partial="evidence")), layout, encoding)
    assert [(f.name, f.dataType) for f in table.schema] == [(f.name, f.dataType) for f in want.schema]
    for a, b in zip(table.orderBy("record_index").collect(), want.orderBy("record_index").collect(), strict=True):
        assert tuple(a) == tuple(b), (a, b)
    assert table.where("G_2 is not null").count() > 0 and table.count() == 1501


def test_uses_of_one_frame_do_not_narrow_each_other(spark, tmp_path):
    """Filtered, unfiltered and joined uses of one frame and one view, and records by number."""
    text = "01 R.\n05 K PIC 9(3).\n05 S PIC X(2).\n"
    (tmp_path / "r").write_bytes(b"".join(b"%03d%s" % (i, (b"ab", b"c ")[i % 2]) for i in range(500)) + b"5")
    policy = Policy(5, partial="evidence")
    df = read_records(spark, str(tmp_path / "r"), policy, split_bytes=35)
    using(spark, tmp_path / "r", text, split_bytes=350, partial="evidence")
    for t in (df, spark.table("t")):
        assert (t.where("record_index = 7").count(), t.count(), t.where("record_index >= 490").count()) == (1, 501, 11)
        assert t.where("record_index < 3").union(t.where("record_index > 497")).count() == 6
    assert spark.sql("SELECT count(*) AS n FROM t WHERE K > 490 AND S = 'c'").first()["n"] == 5
    for first, last in ((7, 7), (0, 0), (498, 500), (500, 500), (501, 501), (6, 40)):
        got = read_records(spark, str(tmp_path / "r"), policy, split_bytes=35, first=first, last=last).collect()
        assert sorted(r["record_index"] for r in got) == list(range(first, min(last, 500) + 1)) and all(r["partial"] == (r["record_index"] == 500) for r in got)
    using(spark, tmp_path / "r", text, first=10, last=19, partial="evidence")
    assert spark.table("t").agg({"K": "sum"}).first()[0] == sum(range(10, 20))


def test_fields_and_names(spark, tmp_path):
    (tmp_path / "r").write_bytes(b"1ab2xy")
    text = "01 R.\n05 O-KEY PIC 9.\n88 O-ONE VALUE 1.\n05 O-T PIC X OCCURS 2.\n"
    using(spark, tmp_path / "r", text, fields="o-t(2),O-ONE")
    assert spark.table("t").columns == ["record_index", "O_T_2", "O_ONE"]
    assert [tuple(r) for r in spark.sql("SELECT o_t_2, o_one FROM t ORDER BY record_index").collect()] == [("b", True), ("y", False)]
    (tmp_path / "c.cpy").write_text(text)
    copybook_table.register(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW t USING copybook OPTIONS (path '{tmp_path}/r', copybook_path '{tmp_path}/c.cpy')")
    assert spark.table("t").where("O_ONE").count() == 1
    for bad in ({"fields": "NOPE"}, {"encoding": "utf-16"}, {"copybook_path": "/x"}):
        with pytest.raises(PySparkException):
            using(spark, tmp_path / "r", text, **bad)
    with pytest.raises(PySparkException):
        using(spark, tmp_path / "r", "01 R.\n05 A-B PIC X.\n05 A.\n10 B PIC X.\n05 A-B PIC X.\n")


def test_view_is_pruned(spark, tmp_path):
    layout = compile_layout(EVERY)
    (tmp_path / "r").write_bytes(b"".join(random_records(layout, 50, 7)))
    copybook_table.copybook_view(spark, "v", str(tmp_path / "r"), layout)
    q = spark.sql("SELECT sum(V) AS s, count(*) AS n FROM v WHERE A = 'ab' AND record_index >= 10")
    plan = q._jdf.queryExecution().executedPlan().toString()
    f, a = layout.field("V"), layout.field("A")
    cuts = {int(x.split(",")[1]) for x in plan.split("substring(record#")[1:]}
    assert cuts == {f.offset + 1, a.offset + 1}, plan  # no other field is cut
    assert plan.index("Filter") < plan.index("BatchScan")  # on the bytes of A, before V is cut
    assert q.first()["n"] == spark.table("v").where((F.col("A") == "ab") & (F.col("record_index") >= 10)).count()


def test_manifests_of_folders_and_missing_paths(spark, tmp_path):
    import hashlib

    from recordloom.sources.fixedrec import file_manifest

    folder = tmp_path / "in"
    folder.mkdir()
    policy = Policy(4, partial="evidence")
    assert file_manifest(spark, str(folder), policy).count() == 0
    files = {"a": b"aaaabbbb", "b": b"", "c": b"aaaab"}
    for name, data in files.items():
        (folder / name).write_bytes(data)
    (folder / "_skipped").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: r for r in file_manifest(spark, str(folder), policy).collect()}
    assert {k: (r["record_count"], r["last_offset"], r["exit_code"], r["file_bytes"]) for k, r in got.items()} == {"a": (2, 4, 0, 8), "b": (0, -1, 0, 0), "c": (2, 4, 1, 5)}
    assert all(r["sha256"] == hashlib.sha256(files[k]).hexdigest() for k, r in got.items())
    gone = file_manifest(spark, str(tmp_path / "gone"), policy).first()
    assert (gone["exit_code"], gone["sha256"], gone["file_bytes"], gone["record_count"]) == (5, None, None, 0) and "can't be read" in gone["reason"]


def test_cli_ends_with_a_code_where_nothing_can_be_read(spark, tmp_path, capsys):
    from recordloom.cli import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"1234")
    (tmp_path / "in" / "b").write_bytes(b"12345")
    (tmp_path / "c.cpy").write_text("01 R.\n05 A PIC 9(4).\n")
    assert main(["ingest", "--data", str(tmp_path / "gone"), "--record-len", "4"]) == 5
    assert main(["ingest", "--data", str(tmp_path / "in"), "--record-len", "4"]) == 2
    assert len(capsys.readouterr().out.strip().splitlines()) == 3
    assert main(["totals", "--data", str(tmp_path / "gone"), "--copybook", str(tmp_path / "c.cpy")]) == 5
    assert main(["totals", "--data", str(tmp_path / "in" / "a"), "--copybook", str(tmp_path / "gone.cpy")]) == 5
