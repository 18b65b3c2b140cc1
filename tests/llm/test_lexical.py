import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from recordloom.llm import lexical

from .conftest import docs_of, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k):
    """(item, rank, doc, score) for lists of (id, text)."""
    bags = [(d, terms(t)) for d, t in docs]
    bags = [(d, Counter(w), len(w)) for d, w in bags if w]
    n, total = len(bags), sum(x for _, _, x in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, size in bags:
            m = 25 + 75 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def table(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, text string")


def fixture():
    rng = random.Random(12)
    texts = [prose(i, rng.randint(1, 120)) for i in range(150)] + ["", None, "...", "Ñandú ñandú ÑANDÚ", "a1b2 A1B2 a-1-b-2", "over_and-over over_and-over"]
    texts += [texts[3]] * 4 + [texts[5] + " " + texts[9]]
    docs = [(1000 - i, t) for i, t in enumerate(texts)]
    items = [(i, texts[j]) for i, j in enumerate((3, 5, 9, 20))] + [(50, "ñandú A1B2 over"), (51, None), (52, ""), (53, "nowhere-to-be-found"), (54, texts[7] + " " + texts[7]), (55, "ba ke lo")]
    return docs, items


@pytest.mark.parametrize(("segment", "block"), [(lexical.SEGMENT, lexical.BLOCK_TERMS), (300, 60)])
def test_ranks_equal_brute_force(spark, segment, block):
    docs, items = fixture()
    found = lexical.ranked_documents(table(spark, docs, "doc_id").repartition(3), table(spark, items, "item_id"), k=7, block_terms=block, segment=segment)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, items, 7)


def test_ties_go_by_doc_id_and_null_comes_last(spark):
    docs = [(9, "red fox"), (None, "red fox"), (4, "red fox"), (7, "red fox"), (4, "red fox"), (1, "blue"), (2, "grey owl"), (3, "white owl")]
    items = [(1, "fox"), (1, "fox"), (None, "fox")]
    found = lexical.ranked_documents(table(spark, docs, "doc_id"), table(spark, items, "item_id"), k=5)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, items, 5)
    assert [r["doc_id"] for r in found.where("item_id is null").orderBy("rank").collect()] == [4, 4, 7, 9, None]


def test_search_stops_early_and_is_exact():
    """One long list of falling impacts: the threshold ends the search long before the lists' end."""
    rng = np.random.default_rng(3)
    n = 20_000
    terms_ = np.tile([0, 1], n)
    impacts = np.stack([np.sort(rng.integers(1, 10**6, n))[::-1], rng.integers(1, 1000, n)], axis=1).ravel()
    segment = lexical.Segment(np.arange(0, 2 * n + 1, 2), terms_, impacts, 2)
    docs, scores, read = segment.best(np.array([0, 1]), np.array([1, 2]), 10)
    whole = impacts[::2] + 2 * impacts[1::2]
    assert read < 2000 and scores.tolist() == sorted(whole.tolist(), reverse=True)[:10] and (whole[docs] == scores).all()
    again = segment.best(np.array([1]), np.array([1]), 3)[1]
    assert again.tolist() == sorted(impacts[1::2].tolist(), reverse=True)[:3]


def test_equal_scores_are_all_met():
    """More documents of one score than k: the least numbers win, wherever they are in the list."""
    segment = lexical.Segment(np.arange(0, 501), np.zeros(500, np.int64), np.full(500, 7), 1)
    assert segment.best(np.array([0]), np.array([1]), 4)[0].tolist() == [0, 1, 2, 3]


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    items = awkward.selectExpr("doc_id AS item_id", "text", "score", "part", "n", "key AS rank")
    found = lexical.ranked_documents(awkward, items, k=10).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows, rows, 10)
    assert lexical.ranked_documents(nothing, items).count() == lexical.ranked_documents(awkward, items.limit(0)).count() == 0
    assert lexical.ranked_documents(docs_of(spark, ["", None]), items).count() == 0
