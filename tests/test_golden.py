"""The engine's encoding, layouts and decoding against published digests."""

import hashlib
import json
from decimal import Decimal

import golden
import pytest
from pyspark.sql import functions as F

from recordloom.functions.decode import decode
from recordloom.functions.encode import encode_record
from recordloom.operators.recon import audit_receipt, record_json
from recordloom.plans.copybook import compile_layout

FAMILIES = list(golden.COPYBOOKS)


def layout_of(family):
    return compile_layout(golden.COPYBOOKS[family], golden.MEMBERS)


def records(spark, family):
    layout, rows = layout_of(family), golden.rows(family)
    names = [f.name for f in layout.elementary()]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["record_index", *names]).repartition(3)
    kinds = {f.name: F.col(f"`{f.name}`").cast("decimal(38,10)") if f.category != "alphanumeric" else F.col(f"`{f.name}`") for f in layout.elementary()}
    made = df.select("record_index", encode_record(layout, kinds, golden.ENCODING[family]).alias("record"))
    return made.withColumn("raw_offset", F.col("record_index") * layout.record_len).withColumn("raw_len", F.length("record"))


@pytest.mark.parametrize("family", FAMILIES)
def test_layout(family):
    layout = layout_of(family)
    assert layout.record_len == golden.RECORD_LEN[family]
    assert layout.layout_hash == golden.LAYOUT_HASH[family]
    assert hashlib.sha256(layout.expanded.encode()).hexdigest() == golden.EXPANDED_SHA256[family]


@pytest.mark.parametrize("family", FAMILIES)
def test_encode_and_decode(spark, family):
    layout, df = layout_of(family), records(spark, family)
    data = b"".join(bytes(r["record"]) for r in df.orderBy("record_index").collect())
    assert hashlib.sha256(data).hexdigest() == golden.INPUT_SHA256[family]
    got = decode(df, layout, golden.ENCODING[family]).orderBy("record_index").collect()
    for r, want in zip(got, golden.rows(family), strict=True):
        for f, text in zip(layout.elementary(), want, strict=True):
            assert r[f.name] == (text if f.category == "alphanumeric" else Decimal(text)), f.name
    lines = record_json(df, layout, golden.ENCODING[family])
    receipt = audit_receipt(df, lines, layout, family).first()
    assert receipt["record_count"] == 120 and receipt["unsupported_count"] == 0
    if family in golden.OUTPUT_SHA256:
        assert receipt["decode_output_sha256"] == golden.OUTPUT_SHA256[family]
    first = json.loads(lines.where("record_index = 0").first()["line"])
    assert first["audit"]["raw_len"] == layout.record_len and set(first["fields"]) == {f.name for f in layout.elementary()}
