import random
import re
from collections import defaultdict

from recordloom.llm import mixing

from .conftest import docs_of, prose


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        level = left / w if w else 0
        above = {s for s in names if s not in full and weight[s] * level > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= above


def corpus(spark):
    rng = random.Random(8)
    sources = ["a", "b", None, "c", "b", "Z", "b", "b", "é"]
    texts = [prose(i, int(rng.paretovariate(1.0) * 5) + 1) if i % 50 else ["", None, " "][i // 50 % 3] for i in range(900)]
    return docs_of(spark, texts, sources)


def test_targets_and_taken_words(spark):
    docs = corpus(spark)
    rows = mixing.mixed_copies(docs).collect()
    assert len(rows) == docs.count() and len({r["doc_id"] for r in rows}) == len(rows)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]] or ""))
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(r["source_size"] == sizes[r["source"]] for r in rows)
    want = brute_targets(sizes)
    assert target.keys() == want.keys()
    for s in want:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - want[s]) <= max(5, 0.01 * want[s]), s


def test_reruns_agree(spark):
    docs = corpus(spark)
    one, two = (sorted(map(tuple, d.select("doc_id", "taken", "copies").collect())) for d in (mixing.mixed_copies(docs), mixing.mixed_copies(docs.repartition(7))))
    assert one == two


def off_target(rows):
    """Each source's distance from its target and its smallest document."""
    taken, target, least = defaultdict(int), {}, {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        if r["size"]:
            least[r["source"]] = min(least.get(r["source"], r["size"]), r["size"])
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    return {s: (abs(taken[s] - target[s]), least[s]) for s in target if s in least}


def test_words_come_within_a_small_document(spark):
    assert all(d <= max(least, 2) for d, least in off_target(mixing.mixed_copies(corpus(spark)).collect()).values())


def test_sources_of_long_documents_only(spark):
    """No small document makes up for what the long ones leave."""
    sizes = [2000 + 1100 * i for i in range(60)]
    docs = docs_of(spark, [f"{s} " + "w " * (s - 1) for s in sizes for _ in "abc"], ["a", "b", "c"])
    found = off_target(mixing.mixed_copies(docs).collect())
    assert len(found) == 3 and all(d <= least for d, least in found.values()), found


def test_few_documents_of_one_size(spark):
    docs = docs_of(spark, ["w " * 500] * 40 + ["w " * 777] * 3, ["a", "b"])
    assert all(d <= least for d, least in off_target(mixing.mixed_copies(docs).collect()).values())


def test_rates_tilt_exponentially(spark):
    """The solved rates meet the target, and log(rate) is a line in the size wherever the limit doesn't bind."""
    cells = spark.createDataFrame([("a", s, n) for s, n in ((1, 50), (5, 30), (20, 10), (100, 2))], "source string, size long, n long")
    total = 50 + 150 + 200 + 200
    targets = spark.createDataFrame([("a", total, 0.8 * total)], "source string, source_size long, target double")
    found = mixing.balanced(cells, targets).first()
    import math

    rate = {s: min(2.0, 1.5 * math.exp(found["multiplier"] * s / found["mean"])) for s in (1, 5, 20, 100)}
    assert abs(sum(rate[s] * s * n for s, n in ((1, 50), (5, 30), (20, 10), (100, 2))) - 0.8 * total) < 1e-3


def test_awkward_rows(awkward, nothing):
    rows = mixing.mixed_copies(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mixed_copies(nothing).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mixed_copies(awkward.where("text is null")).collect())
