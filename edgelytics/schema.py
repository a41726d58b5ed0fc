"""Column contracts and vocabularies of the edge data model."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Neurotransmitter labels and their probability columns. The order
# decides how ties are listed and which label wins an equal tail count.
NEUROTRANSMITTERS = (
    ("GABA", "gaba_avg"),
    ("Acetylcholine", "ach_avg"),
    ("Glutamate", "glut_avg"),
    ("Octopamine", "oct_avg"),
    ("Serotonin", "ser_avg"),
    ("Dopamine", "da_avg"),
)

NT_LABELS = [label for label, _ in NEUROTRANSMITTERS]
NT_COLUMNS = [column for _, column in NEUROTRANSMITTERS]
EDGE_KEY = ["src", "dst", "neuropil"]


def _fields(*specs: tuple[str, T.DataType]) -> list[T.StructField]:
    return [T.StructField(name, dtype, True) for name, dtype in specs]


_PROBABILITIES = _fields(*[(c, T.DoubleType()) for c in NT_COLUMNS])
_DOMINANT = _fields(("dominant_score", T.DoubleType()), ("dominant_nt", T.StringType()))

# Raw connection rows. `ord` is the input position: files read by Spark have no
# row order, and "the later row wins" and "the first n rows" both need one.
CONNECTIONS = T.StructType(
    _fields(
        ("ord", T.LongType()),
        ("pre_pt_root_id", T.LongType()),
        ("post_pt_root_id", T.LongType()),
        ("neuropil", T.StringType()),
        ("syn_count", T.IntegerType()),
    )
    + _PROBABILITIES
)

# Connections with the dominant columns. In storage, `neuropil` is the partition column.
GOLD = T.StructType(CONNECTIONS.fields + _DOMINANT)
GOLD_NARROW = T.StructType([f for f in GOLD.fields if f.name not in NT_COLUMNS])

# Property-graph tables. An edge is identified by (src, dst, neuropil); `ord` is
# the input position of the row that last set it.
EDGES = T.StructType(
    _fields(
        ("src", T.LongType()),
        ("dst", T.LongType()),
        ("neuropil", T.StringType()),
        ("syn_count", T.IntegerType()),
    )
    + _PROBABILITIES
    + _DOMINANT
    + _fields(("ord", T.LongType()))
)
NEURONS = T.StructType(_fields(("root_id", T.LongType())))
DEGREES = T.StructType(
    _fields(("root_id", T.LongType()), ("out_deg", T.LongType()), ("in_deg", T.LongType()))
)

# Synapse-count histogram cube: every summary figure is a roll-up of this table.
CUBE = T.StructType(
    _fields(
        ("neuropil", T.StringType()),
        ("dominant_nt", T.StringType()),
        ("syn_count", T.IntegerType()),
        ("count", T.LongType()),
    )
)

# Mergeable sketches of the ids of some input.
SKETCHES = T.StructType(_fields(("senders", T.BinaryType()), ("receivers", T.BinaryType())))

PATH_EDGE = T.StructType(
    _fields(
        ("source_id", T.LongType()),
        ("target_id", T.LongType()),
        ("syn_count", T.IntegerType()),
        ("neuropil", T.StringType()),
        ("dominant_nt", T.StringType()),
        ("dominant_score", T.DoubleType()),
    )
)

HISTOGRAM = T.ArrayType(
    T.StructType(_fields(("syn_count", T.IntegerType()), ("count", T.LongType())))
)
_COUNTED = _fields(("total_pairs", T.LongType()), ("histogram", HISTOGRAM))
_BY_NT = T.MapType(T.StringType(), T.StructType(_COUNTED))

# The dashboard summary document.
SUMMARY_DOCUMENT = T.StructType(
    _fields(
        ("input", T.StringType()),
        ("max_rows", T.LongType()),
        ("total_rows", T.LongType()),
        ("neurotransmitters", T.ArrayType(T.StringType())),
        (
            "unique",
            T.StructType(
                _fields(
                    ("pre_pt_root_id", T.LongType()),
                    ("post_pt_root_id", T.LongType()),
                    ("neuron_ids_union", T.LongType()),
                    ("neuropil", T.LongType()),
                )
            ),
        ),
        (
            "syn_count",
            T.StructType(
                _fields(
                    ("min", T.IntegerType()),
                    ("max", T.IntegerType()),
                    ("median", T.IntegerType()),
                    ("quantiles", T.MapType(T.StringType(), T.IntegerType())),
                    ("histogram", HISTOGRAM),
                )
            ),
        ),
        (
            "by_neuropil",
            T.MapType(
                T.StringType(),
                T.StructType(_COUNTED + _fields(("by_neurotransmitter", _BY_NT))),
            ),
        ),
        ("by_neurotransmitter", _BY_NT),
    )
)

# One stored dashboard summary per dataset id.
SUMMARY_RECORD = T.StructType(
    _fields(
        ("dataset_id", T.StringType()),
        ("summary_json", T.StringType()),
        ("input", T.StringType()),
        ("total_rows", T.LongType()),
        ("max_rows", T.LongType()),
        ("pre_pt_root_id", T.LongType()),
        ("post_pt_root_id", T.LongType()),
        ("neuron_ids_union", T.LongType()),
        ("neuropil", T.LongType()),
        ("syn_min", T.LongType()),
        ("syn_max", T.LongType()),
        ("syn_median", T.LongType()),
        ("updated_at", T.TimestampType()),
    )
)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Return `df` unchanged, or raise before any job starts if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df
