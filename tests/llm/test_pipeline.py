"""The pipeline's stages, each against a brute-force version or the law that it states."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from recordloom.llm import toxicity

from .conftest import docs_of, edited, prose
from .test_contamination import brute as contained
from .test_neardup import brute as components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_are_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]


def test_toxic_documents_go(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = pipeline.reject_toxic(spark, documents, SF)
    assert kept.columns == documents.columns
    machine = toxicity.learn(documents, labels.where(~toxicity.held_out(F.col("doc_id"))))
    assert ids(kept) == ids(toxicity.with_scores(documents, machine).where("score < 0.5"))


def test_one_of_each_group_stays(spark, documents):
    rows = documents.orderBy("doc_id").collect()
    want = components([r["text"] for r in rows], 5, 80)
    kept = pipeline.drop_near_copies(spark, documents, SF)
    assert kept.columns == documents.columns
    assert ids(kept) == Counter(rows[i]["doc_id"] for i, (_, root) in want.items() if root == i)


def test_documents_with_benchmark_items_go(spark, documents):
    rows = documents.orderBy("doc_id").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {rows[d]["doc_id"] for d, _ in contained([r["text"] for r in rows], items)}
    assert ids(pipeline.drop_contaminated(spark, documents, SF)) == Counter(r["doc_id"] for r in rows if r["doc_id"] not in bad)


def test_copies_and_shards(spark, documents):
    mixed = pipeline.mix_sources(spark, documents, SF)
    assert mixed.columns == documents.columns
    copies = ids(mixed)
    assert copies and set(copies.values()) <= {1, 2}
    shards = pipeline.cut_shards(spark, documents, SF).groupBy("shard").count().collect()
    assert len(shards) == 40 and max(r["count"] for r in shards) - min(r["count"] for r in shards) <= 1


def test_whole_run(spark):
    rows = pipeline.run(spark, SF).collect()
    assert rows and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)


def test_awkward_rows(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for _, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == awkward.columns
        assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_clashing_columns_keep_their_values(spark, nothing):
    """Columns that have the names of results and of helpers, and a map, come out of each stage as they went in."""
    names = ["score", "predicted", "row", "tie", "box", "times", "copies", "component_id", "size", "bins", "__score", "__row", "__copies", "a.b"]
    texts = [prose(500 + i, 40 + i) for i in range(30)]
    rows = [(i, t, "en", "web", len(t), {f"k{i}": i}, *(f"{n}{i}" for n in names)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tags map<string,int>, " + ", ".join(f"`{n}` string" for n in names))
    want = {r[0]: r for r in rows}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        found = out.collect()
        assert len(found) >= 15 and all(tuple(r) == want[r["doc_id"]] for r in found), name
    assert {r["doc_id"] for r in pipeline.cut_shards(spark, docs, SF).collect()} == set(range(30))


def test_documents_without_words_go_through_the_mix_once(spark):
    docs = docs_of(spark, [None, "", " \n", *(prose(i, 20) for i in range(8))])
    assert {i: n for i, n in ids(pipeline.mix_sources(spark, docs, SF)).items() if i < 3} == {0: 1, 1: 1, 2: 1}


def test_near_copies_of_one_text(spark):
    base = prose(77, 300)
    docs = docs_of(spark, [base, *(edited(base, i, 0.01) for i in range(30)), prose(78, 300)])
    assert set(ids(pipeline.drop_near_copies(spark, docs, SF))) == {0, 31}


def with_ids(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def kept_texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_copies_go_by_row_not_by_id(spark):
    """Rows without an id are compared like any other, and rows that share an id but no text are no copies."""
    a, b, c, d = (prose(i, 300) for i in (81, 82, 83, 84))
    near = edited(a, 1, 0.01)
    rows = [(5, a), (None, a), (None, near), (None, b), (None, b), (7, c), (7, d), (7, d), (3, d), (9, c)]
    want = Counter({(5, a): 1, (None, b): 1, (7, c): 1, (3, d): 1})
    for part in (rows, rows[::-1]):
        assert kept_texts(pipeline.drop_near_copies(spark, with_ids(spark, part), SF)) == want


def test_benchmark_passages_go_by_row_not_by_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    leak, clean, other = f"{prose(85, 50)} {item} {prose(86, 50)}", prose(87, 100), prose(88, 100)
    rows = [(None, leak), (None, clean), (4, leak), (4, clean), (6, other)]
    assert kept_texts(pipeline.drop_contaminated(spark, with_ids(spark, rows), SF)) == Counter({(None, clean): 1, (4, clean): 1, (6, other): 1})
