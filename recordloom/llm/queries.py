"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op7_deep_shallow_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeated

    return remove_repeated(_documents(spark, sf_dir))


def op8_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_documents(spark, sf_dir), k=4, percent=80)


def op5_template_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_documents(spark, sf_dir))


def op6_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(_documents(spark, sf_dir))


def op10_contained_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .contamination import contained_items

    return contained_items(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op1_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op2_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import section_tokens

    return section_tokens(_documents(spark, sf_dir), rule="most")


def op3_factorized_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import hilbert_shards

    dims = {"source": F.col("source"), "lang": F.col("lang"), "n_chars": F.col("n_chars")}
    return hilbert_shards(_documents(spark, sf_dir), dims, shards=40, law="rows")


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed_copies

    return mixed_copies(_documents(spark, sf_dir)).drop("source")


def op11_line_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infill import infill_digests

    return infill_digests(_documents(spark, sf_dir))


def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import ranked_documents

    return ranked_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op13_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import packed

    return packed(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).drop("ids", "source")


def queries() -> dict:
    return {f.__name__: f for f in (op1_multi_index_search, op2_section_tokens, op3_factorized_toxicity, op4_hilbert_shards, op5_template_licenses, op6_entropy_secrets, op7_deep_shallow_dedup, op8_minmax_neardup, op9_entropy_mix, op10_contained_benchmark, op11_line_infill, op12_threshold_search, op13_mixture_packing)}


def oracle_sql() -> dict[str, str]:
    from . import contamination, infill, lexical, licenses, secrets

    return {"op5_template_licenses": licenses.oracle(), "op6_entropy_secrets": secrets.oracle(), "op10_contained_benchmark": contamination.oracle(), "op11_line_infill": infill.oracle(), "op12_threshold_search": lexical.oracle()}
