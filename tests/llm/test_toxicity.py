import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import toxicity

from .conftest import docs_of, prose


def test_held_out_accuracy_on_the_test_table(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    scored = toxicity.toxicity(docs, labels)
    rows = scored.join(labels.where("toxic is not null"), "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    y, p, score = (np.array([r[c] for r in rows]) for c in ("toxic", "predicted", "score"))
    assert len(rows) > 100 and 0 < y.sum() < len(y)
    # measured: 0.938 of the toxic rows, no clean one, AUC 0.993
    assert (p[y == 1] == 1).mean() >= 0.9
    assert (p[y == 0] == 0).mean() >= 0.99
    assert (score[y == 1][:, None] > score[y == 0][None]).mean() + 0.5 * (score[y == 1][:, None] == score[y == 0][None]).mean() >= 0.98


def test_scores_equal_the_sum_over_all_pairs(spark):
    """The score is the logistic of bias, weights, and the products of every pair of a text's terms, summed one by one."""
    texts = [prose(i, 6 + i % 9) + (" glorp frumious" if i % 3 == 0 else "") for i in range(60)] + ["", "glorp", None]
    docs = docs_of(spark, texts)
    truth = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    machine = toxicity.learn(docs, truth)
    place = machine.table()
    for r in toxicity.with_scores(docs, machine).collect():
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        bins, _ = toxicity._bins(data, np.array([0, len(data)]))
        at = [place[b] for b in bins if place[b] >= 0]
        z = machine.bias + sum(float(machine.weights[i]) for i in at)
        z += sum(float(machine.vectors[i].astype(float) @ machine.vectors[j].astype(float)) for n, i in enumerate(at) for j in at[n + 1 :])
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-5 and r["predicted"] == int(r["score"] >= 0.5)


def test_labels_of_held_out_rows_are_not_used(spark):
    texts = [prose(i, 30) + (" glorp frumious" if i % 4 == 0 else "") for i in range(400)]
    docs = docs_of(spark, texts)
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    truth = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    flipped = spark.createDataFrame([(i, int((i % 4 == 0) != out(i))) for i in range(400)], "doc_id long, toxic int")
    one, two = (sorted(map(tuple, toxicity.toxicity(docs, t).collect())) for t in (truth, flipped))
    assert one == two
    assert all(r[1] == out(r[0]) and r[3] == int(r[0] % 4 == 0) for r in one)


def paired(rule, seed, n=5000):
    """Rows of two terms and thirty of two thousand others; the label follows from the two alone."""
    rng = np.random.default_rng(seed)
    one, two = rng.random((2, n)) < 0.5
    lists = [np.unique(np.concatenate([[1] * a, [2] * b, rng.integers(10, 2000, 30)])).astype(np.int32) for a, b in zip(one.astype(int), two.astype(int), strict=True)]
    return lists, rule(one, two).astype(float)


def right(machine, lists, y):
    place = {int(t): i for i, t in enumerate(machine.terms)}
    known = [[place[int(t)] for t in terms if int(t) in place] for terms in lists]
    sums = machine.sums(np.repeat(np.arange(len(known)), [len(k) for k in known]), np.concatenate(known).astype(np.int64), len(known))
    return ((sums >= 0) == (y == 1)).mean()


@pytest.mark.parametrize("rule", [np.logical_xor, lambda a, b: ~np.logical_xor(a, b), np.logical_and])
def test_pairs_are_learnt_beyond_single_terms(rule):
    """Where exactly one of two terms, neither or both, or only both make a row toxic: a linear score can't tell the first two apart."""
    lists, y = paired(rule, 1)
    machine = toxicity.fit_sample(lists[:4000], y[:4000])
    assert right(machine, lists[4000:], y[4000:]) >= 0.95


def test_rare_pairs_are_learnt():
    """Two terms of a tenth of the rows each, toxic if exactly one of them is there beside a third of half the rows."""
    rng = np.random.default_rng(5)
    a, b, c = rng.random(6000) < 0.1, rng.random(6000) < 0.1, rng.random(6000) < 0.5
    y = (c & (a ^ b)).astype(float)
    lists = [np.unique(np.concatenate([[1] * i, [2] * j, [3] * k, rng.integers(10, 1000, 20)])).astype(np.int32) for i, j, k in zip(*(v.astype(int) for v in (a, b, c)), strict=True)]
    machine = toxicity.fit_sample(lists[:5000], y[:5000])
    assert right(machine, lists[5000:], y[5000:]) >= 0.95


def test_no_evidence_comes_from_pairs_of_noise():
    lists, y = paired(lambda a, b: np.random.default_rng(9).random(len(a)) < 0.3, 4)
    start = np.cumsum([0, *map(len, lists)])
    assert (toxicity._pair_evidence(start, np.concatenate(lists), y, 2000) == 0).all()


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (None, 1, 0), (8, None, 0), (5, 0, 0), (5, 1, 0)], "doc_id long, toxic int, h long")
    for some in (labels, labels.limit(0), labels.where("toxic = 0")):
        rows = toxicity.toxicity(awkward, some).collect()
        assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
        assert all(r["held_out"] is None for r in rows if r["doc_id"] is None)
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.toxicity(nothing, labels).count() == 0
    kept = toxicity.with_scores(awkward, toxicity.learn(awkward, labels))
    assert set(kept.columns) == {*awkward.columns, "predicted"} and kept.where(F.col("items") == "x").count() == awkward.count()


def test_the_pipeline_stage_on_the_test_table(spark):
    """Of the held-out rows, nine tenths of the toxic ones go and the clean ones stay."""
    import corpus_pipeline

    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.reject_toxic(spark, docs, at).select("doc_id").collect()}
    rows = labels.where("toxic is not null").where(toxicity.held_out(F.col("doc_id"))).collect()
    y, gone = np.array([r["toxic"] for r in rows]), np.array([r["doc_id"] not in kept for r in rows])
    assert gone[y == 1].mean() >= 0.9
    assert gone[y == 0].mean() <= 0.01


def test_few_labels_and_rare_forms_get_weights():
    """Each toxic row has its own form of one word, none in five rows: single words alone would be left out."""
    texts = [prose(i, 40) + (f" glorp{'abcdefghijklmnop'[i // 4 % 16]}{i}" if i % 4 == 0 else "") for i in range(120)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bins, at = toxicity._bins(data, np.cumsum([0, *map(len, texts)]))
    lists = [bins[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    y = np.array([i % 4 == 0 for i in range(120)], float)
    machine = toxicity.fit_sample(lists[:80], y[:80])
    assert set(machine.terms) == set(np.concatenate(lists[:80]).tolist())
    place = [p[p >= 0] for p in (machine.table()[b] for b in lists[80:])]
    z = machine.sums(np.repeat(np.arange(40), [len(p) for p in place]), np.concatenate(place), 40)
    assert ((z >= 0) == (y[80:] == 1)).mean() >= 0.95
