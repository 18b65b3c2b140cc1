import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import common, sharding

from .conftest import docs_of, prose


def dims():
    return {k: F.col(k) for k in ("source", "lang", "n_chars", "doc_id")}


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_unit_steps(n, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), axis=-1).reshape(-1, n)
    index = sharding.hilbert_index(points, bits)
    assert sorted(index) == list(range(len(points)))
    path = points[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_laws(spark, law):
    texts = [prose(i, 5 + (i * 37) % 200) for i in range(430)] + ["same text again"] * 30
    docs = docs_of(spark, texts, ["a", "b", "c"])
    rows = sharding.hilbert_shards(docs, dims(), shards=8, law=law).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(460))
    by_shard = defaultdict(list)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), law, None)
        by_shard[r["shard"]].append(r)
    assert sorted(by_shard) == list(range(8))
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in by_shard.values())
    if law == "rows":
        assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    else:
        sizes = [sum(r["size"] for r in s) for s in by_shard.values()]
        assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)


def quantiles(values, bits=sharding.BITS):
    """For each value how many of the cuts lie below it; a cut is a value at which the running count passes a 2**bits-th of all."""
    known, run, cuts = sorted(v for v in values if v is not None), 0, []
    for v in sorted(set(known)):
        before, run = run, run + known.count(v)
        if run < len(known) and run * (1 << bits) // len(known) > before * (1 << bits) // len(known):
            cuts.append(v)
    return [sum(c < v for c in cuts) if v is not None else 0 for v in values]


def test_order_and_cuts_equal_brute_force(spark, monkeypatch):
    texts = [prose(i, 3 + (i * 37) % 90) if i % 3 else f"copy {i % 7}" for i in range(330)]
    docs = docs_of(spark, texts, ["a", "b", None, "c"])
    rows = docs.orderBy("doc_id").collect()
    points = np.array([quantiles([r[c] for r in rows]) for c in ("source", "n_chars")]).T
    place = sharding.hilbert_index(points, sharding.BITS).tolist()
    first = {t: min(p for p, x in zip(place, texts, strict=True) if x == t) for t in texts}
    for most in (200_000, 1):
        monkeypatch.setattr(common.matched, "__defaults__", (most, "inner"))
        found = {r["doc_id"]: r for r in sharding.hilbert_shards(docs, {c: F.col(c) for c in ("source", "n_chars")}, shards=8).collect()}
        assert all(found[i]["curve"] == first[t] for i, t in enumerate(texts))
        order = sorted(range(330), key=lambda i: (found[i]["shard"], found[i]["slot"]))
        assert [found[i]["curve"] for i in order] == sorted(first[t] for t in texts)
        assert [found[i]["shard"] for i in order] == [i * 8 // 330 for i in range(330)]
        together = [texts[i] for i in order]
        runs = [t for i, t in enumerate(together) if i == 0 or together[i - 1] != t]
        assert len(runs) == len(set(texts))
        assert sum(len({found[i]["shard"] for i in range(330) if texts[i] == t}) > 1 for t in set(texts)) <= 7


def test_runs_are_narrow_in_every_dimension(spark):
    rows = [(i, f"t{i}", f"s{i % 16:02}", (i * 7919) % 4096) for i in range(4096)]  # equal texts would lie together
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    found = sharding.hilbert_shards(docs, {"source": F.col("source"), "n_chars": F.col("n_chars")}, shards=64)
    spans = found.join(docs.drop("text"), "doc_id").groupBy("shard").agg(F.countDistinct("source").alias("s"), (F.max("n_chars") - F.min("n_chars")).alias("w")).collect()
    assert np.mean([r["s"] / 16 for r in spans]) < 0.4 and np.mean([r["w"] / 4096 for r in spans]) < 0.4


def test_awkward_rows(awkward, nothing):
    for law in ("rows", "bytes"):
        rows = sharding.hilbert_shards(awkward, dims(), shards=40, law=law).collect()
        assert len(rows) == awkward.count()
        assert all(r["size"] == 16 and r["text_crc32"] == 0 for r in rows if r["doc_id"] in (1, 2))
        assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
        assert sharding.hilbert_shards(nothing, dims(), law=law).count() == 0
    with pytest.raises(ValueError, match="unknown law"):
        sharding.hilbert_shards(awkward, dims(), law="key")
