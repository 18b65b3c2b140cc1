import hashlib
import random
from collections import Counter

import pytest

from recordloom.llm import common, substrings

from .conftest import docs_of, prose, rows_of


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = {}
    for n, d in enumerate(data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out[n] = (len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def fixture_texts():
    rng = random.Random(2)
    passage, other = prose(11, 40), prose(12, 40)
    texts = [f"{prose(100 + i, rng.randint(5, 40))} {passage[rng.randint(0, 60):]} {prose(200 + i, 20)}" for i in range(15)]
    texts += [prose(300, 50), prose(300, 50), other + " " + other, "ab" * 300, "a" * 150, "x" * 39, "", None, "é" * 60, prose(400, 80)]
    texts += [prose(400, 80)[k : k + 120] for k in (0, 3, 50)]
    return texts


def test_crowded_grams_are_parted_by_further_bytes(spark, monkeypatch):
    """A gram in 60 contexts, equal strings of every length around the anchor, and keys of many rows with no side broadcast."""
    rng = random.Random(5)
    core, letters = prose(31, 12)[:60], "abc"
    around = lambda n: "".join(rng.choice(letters) for _ in range(n))
    ends = [around(30) for _ in range(4)]
    texts = [rng.choice(ends)[rng.randint(0, 20) :] + core + rng.choice(ends)[: rng.randint(0, 30)] + f" {i}" for i in range(60)]
    texts += [f"{around(rng.randint(0, 9))}{core[9:50]}{around(rng.randint(0, 9))}" for _ in range(40)]
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common.matched, "__defaults__", (3, "inner"))
    for group in (2, 7):
        found = rows_of(substrings.remove_repeated(docs_of(spark, texts), length=40, gram=8, largest_group=group))
        assert {i: tuple(r)[1:] for i, r in found.items()} == brute(texts, 40)


@pytest.mark.parametrize("largest_group", [20_000, 2])
def test_removed_bytes_equal_brute_force(spark, largest_group):
    texts = fixture_texts()
    found = rows_of(substrings.remove_repeated(docs_of(spark, texts), length=40, gram=8, largest_group=largest_group))
    assert {i: tuple(r)[1:] for i, r in found.items()} == brute(texts, 40)


def test_awkward_rows(awkward, nothing):
    rows = substrings.remove_repeated(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[5]["n_removed"] == by_id[5]["n_bytes"] == by_id[6]["n_removed"] > 400
    assert by_id[1]["n_bytes"] == by_id[2]["n_bytes"] == 0 and by_id[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by_id[7]["n_removed"] == 0 and by_id[7]["n_bytes"] == len("Zwölf Boxkämpfer あ\U0001f600 jagen".encode())
    assert substrings.remove_repeated(nothing).count() == 0


def test_repeated_rows_are_occurrences(spark):
    text = prose(21, 100)
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, prose(22, 100))], "doc_id long, text string")
    rows = substrings.remove_repeated(docs, length=100).collect()
    assert sorted((r["n_removed"] == r["n_bytes"], r["n_removed"]) for r in rows) == [(False, 0)] + [(True, len(text))] * 3


def test_many_repeated_rows_are_worked_on_once(spark):
    """A thousand equal rows of 60 kB, null ids included; another text shares a passage with them."""
    text, other = prose(31, 10_000), prose(32, 300)
    docs = spark.createDataFrame([(None, text)] * 1000 + [(1, other + text[:900] + other[::-1]), (2, prose(33, 50)), (2, prose(33, 50))], "doc_id long, text string").repartition(4)
    rows = substrings.remove_repeated(docs).collect()
    assert sum(r["doc_id"] is None and r["n_removed"] == r["n_bytes"] == len(text) and r["n_spans"] == 1 for r in rows) == 1000
    one = next(r for r in rows if r["doc_id"] == 1)
    assert one["kept_sha256"] == hashlib.sha256((other + other[::-1]).encode()).hexdigest() and one["n_removed"] == 900
    assert [r["n_removed"] for r in rows if r["doc_id"] == 2] == [0 if len(prose(33, 50)) < 400 else len(prose(33, 50))] * 2


def test_deep_shallow_order_sorts():
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [b"a" * 40, b"a" * 40, b""]
    for shallow in (0, 2, 8):
        order = substrings.deep_shallow_order(strings, 0, shallow)
        assert sorted(order) == list(range(len(strings)))
        assert [strings[i] for i in order] == sorted(strings)
    assert [strings[i] for i in substrings.blind_trie_order(strings, list(range(len(strings))))] == sorted(strings)
