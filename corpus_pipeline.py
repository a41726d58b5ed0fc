"""The corpus pipeline: five operators one after another over `documents`.

Each stage takes all documents that its predecessor kept, and its decisions take effect:
toxic documents go, shared lines go, one document of each near-duplicate group stays,
sources are mixed to their targets, and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelytics.llm import line_dedup, mixing, packing, simhash, toxicity
from edgelytics.llm.common import table
from edgelytics.llm.queries import vocabulary_path
from edgelytics.session import scratch_path


#: What operators see of a document beside key, text and source: everything else in one
#: column, so that no name of `docs` meets one of theirs.
REST = "_rest"


def _packed(docs: DataFrame, *own: str) -> DataFrame:
    """The named columns of `docs` and one column with all the others."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in own]
    rest = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    return docs.select(*[F.col(f"`{c}`") for c in own], rest.alias(REST))


def _unpacked(found: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    """The columns of `docs` in their order, n_chars brought up to date with the text."""
    columns = [F.col(f"`{c}`") if c in own else F.col(REST)[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast(kind)
        columns[docs.columns.index("n_chars")] = length.alias("n_chars")
    return found.select(*columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic. The lexicon is learned from the labels' learning rows."""
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    lexicon = toxicity.learn_lexicon(docs.select("doc_id", "text"), labels)
    own = ["doc_id", "text"]
    scored = toxicity.score_texts(_packed(docs, *own), lexicon, keep=[*own, REST])
    return _unpacked(scored.filter("predicted = 0"), docs, *own)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more documents share; every document stays, an
    emptied one with an empty text."""
    found = line_dedup.drop_shared_lines(_packed(docs, "doc_id", "text"), keep=["doc_id", REST])
    return _unpacked(found.withColumnRenamed("kept_text", "text"), docs, "doc_id", "text")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates, by fingerprints
    of three-word shingles within three bits; all rows without a doc_id stay, and all rows
    of a doc_id that stays."""
    found = simhash.near_duplicates(docs.select("doc_id", "text"), width=3, bits=3)
    kept = found.filter("doc_id = component").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    return named.unionByName(docs.filter("doc_id is null"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once for each pass over its source that takes some of its words,
    with these words."""
    own = ["doc_id", "text", "source"]
    return _unpacked(mixing.mix_documents(_packed(docs, *own)), docs, *own)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's pieces in sequences of 2048 tokens."""
    # a small store: the workers keep it while other stages run
    packed = packing.pack_documents(docs.select("doc_id", "text"), vocabulary_path(), 2048, store_words=120_000)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned scores, 64-bit hashes, permutations and tokens are beyond SQL; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each result written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
