import itertools
import re

import numpy as np
import pytest

from recordloom.llm import neardup

from .conftest import docs_of, edited, prose, rows_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(texts, k, percent):
    sets = {i: shingle_set(t, k) for i, t in enumerate(texts)}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_components_equal_brute_force(spark, k):
    base = prose(5, 120)
    texts = [prose(i, 60) for i in range(20)]
    texts += [edited(base, i, 0.02) for i in range(40)]  # a star around one text, many of whose pairs are not links
    texts += [prose(3, 60), prose(3, 60).upper(), prose(4, 60) + " tail", "a b", "A  b", "a b c", "", None]
    chain = prose(9, 200).split(" ")
    texts += [" ".join(chain[5 * i : 5 * i + 100]) for i in range(12)]  # links only between neighbours
    found = rows_of(neardup.near_duplicates(docs_of(spark, texts), k=k, percent=80))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == brute(texts, k, 80)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in found.items())


def test_awkward_rows(awkward, nothing):
    rows = neardup.near_duplicates(awkward, k=4).collect()
    assert len(rows) == awkward.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [by_id[i]["component_id"] for i in range(1, 9)] == [1, 2, 3, 4, 5, 5, 7, 8]
    assert [by_id[i]["n_shingles"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert neardup.near_duplicates(nothing).count() == 0


def test_minmax_signature_estimates_similarity():
    a, b = neardup._permutations(500)
    rng = np.random.Generator(np.random.PCG64(0))
    shared, own = rng.integers(0, 2**64, 800, dtype=np.uint64), rng.integers(0, 2**64, 400, dtype=np.uint64)
    one, two = (neardup.minmax(np.concatenate([shared, x]), a, b) for x in (own[:200], own[200:]))
    assert abs((one == two).mean() - 800 / 1200) < 0.06


def test_components_of_long_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(200, 300)]
    hub = [(1000, i) for i in range(1001, 1400)]
    edges = spark.createDataFrame(path + hub, "a long, b long")
    found = {r["node"]: r["root"] for r in neardup.components(edges).collect()}
    assert found == {i: 200 for i in range(200, 301)} | {i: 1000 for i in range(1000, 1400)}
