import re

from recordloom.llm import contamination

from .conftest import docs_of, edited, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [x for x in re.split(contamination.PARTS, (text or "").translate(LOWER)) if x]


def runs(w, m):
    return {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}


def brute(texts, items, percent=80, k=5):
    out = {}
    for i, item in items:
        m = min(k, len(words(item)))
        own = runs(words(item), m) if m else set()
        for d, t in enumerate(texts):
            if own and 100 * (n := len(own & runs(words(t), m))) >= percent * len(own):
                out[d, i] = (len(own), n)
    return out


def test_short_items_are_found_inside_long_documents(spark):
    items = [(1, "alpha"), (2, "alpha beta"), (3, "Alpha, beta! GAMMA"), (4, "alpha beta gamma delta"), (5, "beta alpha"), (6, "alpha beta gamma delta epsilon")]
    texts = ["alpha beta gamma", f"{prose(1, 500)} alpha beta gamma delta, {prose(2, 500)}", "alpha", "gamma beta alpha", prose(3, 50), f"{prose(4, 300)} alpha beta gamma delta epsilon"]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in contamination.contained_items(docs_of(spark, texts), table).collect()}
    assert found == brute(texts, items) and {(1, 4), (1, 3), (5, 4), (0, 2), (3, 5)} <= found.keys()


def test_contained_items_equal_brute_force(spark):
    items = [(i, prose(500 + i, 12 + 5 * i)) for i in range(12)] + [(50, "two words"), (51, "!!"), (52, prose(500, 12)), (53, None)]
    texts = [f"{prose(i, 300)} {items[i % 12][1].upper().replace(' ', ', ')} {prose(i + 50, 300)}" for i in range(24)]
    texts += [prose(i + 900, 50) + " " + edited(items[i % 12][1], i, 0.04) for i in range(24)]
    texts += ["Two words!", "two words more", "", None, items[3][1], " ".join(items[8][1].split()[:30])]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in contamination.contained_items(docs_of(spark, texts), table).collect()}
    assert found == brute(texts, items)
    assert {d for d, _ in found} >= set(range(24))


def test_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "twice the same row of words", 0), (1, "twice the same row of words", 0), (2, None, 0), (None, "one", 0), (3, "ONE", 0)], "item_id long, text string, h long")
    rows = {(r["doc_id"], r["item_id"]) for r in contamination.contained_items(awkward, items).collect()}
    assert rows == {(8, 1), (4, 3)}
    assert contamination.contained_items(nothing, items).count() == 0
    assert contamination.contained_items(awkward, items.limit(0)).count() == 0


def test_a_miss_is_improbable():
    assert contamination.miss_probability() < 1e-10
