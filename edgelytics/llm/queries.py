"""Registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelytics.llm import (
    ann,
    filter_audit,
    line_dedup,
    max_sketch,
    mixing,
    packing,
    quality,
    sharding,
    simhash,
    substring,
    subword_lm,
    toxicity,
    url_filter,
)
from edgelytics.llm.common import table
from edgelytics.session import scratch_path

#: Name of the vocabulary file of the packing queries; the folder is the installed package's.
VOCABULARY = "word_bpe_49k.json"
#: The vocabulary whose pieces the language model weighs.
PIECES = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_robust_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    found = url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)
    return found.select("page_id", "host", "path", "rule", "verdict", "passed_on")


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    found = toxicity.score_texts(docs, toxicity.learn_lexicon(docs, labels))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "hits")


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.drop_shared_lines(docs, keep=["doc_id"], with_text=False)
    return found.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "source", "size", "source_size", "target", "taken")


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id")
    )


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16, scratch_path(spark, "slot-map"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = packing.pack_documents(docs, vocabulary_path(), 2048)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring.drop_repeated_passages(docs, keep=["doc_id"], with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.clean_lines(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_failed_lines", "n_failed_words",
    )


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return subword_lm.score_texts(docs, vocabulary_path(PIECES))


@query
def op11_max_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
