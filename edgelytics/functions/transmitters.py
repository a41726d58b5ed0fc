"""Row-level neurotransmitter expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgelytics.schema import NEUROTRANSMITTERS, NT_COLUMNS, NT_LABELS, require_columns


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by null in every floating-point column."""
    return df.withColumns({c: F.nanvl(c, F.lit(None)) for c in float_columns(df)})


def nan_counts(df: DataFrame) -> DataFrame:
    """How many NaN values each floating-point column holds, one row per column."""
    names = float_columns(df)
    counted = df.agg(*[F.count_if(F.isnan(c)).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nan_rows")) for c in names])
    return counted.select(F.inline(pairs))


def _at_maximum(score: Column) -> list[Column]:
    return [F.when(F.col(column) == score, F.lit(label)) for label, column in NEUROTRANSMITTERS]


def with_dominant(connections: DataFrame) -> DataFrame:
    """Add `dominant_score` (row maximum) and `dominant_nt` (labels at it, comma-joined).

    Ties list every label in vocabulary order; a row without any probability gets
    a null score and an empty text. NaN counts as missing.
    """
    require_columns(connections, NT_COLUMNS)
    scored = nan_to_null(connections).withColumn("dominant_score", F.greatest(*NT_COLUMNS))
    return scored.withColumn("dominant_nt", F.concat_ws(",", *_at_maximum(F.col("dominant_score"))))


def drop_probabilities(df: DataFrame) -> DataFrame:
    return df.drop(*NT_COLUMNS)


def nt_tokens(text: Column | str) -> Column:
    """Split a dominant-NT text into its trimmed, non-blank labels."""
    return F.filter(F.transform(F.split(text, ","), lambda token: F.trim(token)), lambda token: token != "")


def explode_nt(df: DataFrame, include_unassigned: bool = False) -> DataFrame:
    """One row per dominant label in column `nt`: a tied row counts toward each label.

    With `include_unassigned`, rows whose text is empty appear under the label "".
    """
    exploded = df.select("*", F.explode(F.split("dominant_nt", ",")).alias("nt"))
    labelled = exploded.withColumn("nt", F.trim("nt"))
    return labelled if include_unassigned else labelled.where("nt <> ''")


def is_tied(text: Column | str = "dominant_nt") -> Column:
    """Whether a dominant-NT text names more than one label."""
    return F.contains(F.col(text) if isinstance(text, str) else text, F.lit(","))


def tied_rows(df: DataFrame) -> DataFrame:
    """The rows whose dominant-NT text names more than one label.

    Spark moves a plain condition on a derived text below joins and writes the text out in
    it, where each of its parts repeats the row maximum and with it every probability. A
    generated column stays where it is, so the text is made once a row.
    """
    tested = df.select("*", F.explode(F.array(is_tied())).alias("_tied"))
    return tested.where("_tied").drop("_tied")


def vocabulary_rank(nt: Column) -> Column:
    """Position of a label in the vocabulary; null for a label outside it."""
    position = F.array_position(F.array(*map(F.lit, NT_LABELS)), nt)
    return F.when(position > 0, position)
