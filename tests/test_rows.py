"""Row expressions, filters and reports on the hand-made fixture."""

import pytest
from conftest import NONE6, TINY, rows
from pyspark.sql import functions as F

from edgelytics.functions import transmitters as nt
from edgelytics.functions.filters import EdgeFilter
from edgelytics.operators import reports
from edgelytics.schema import CONNECTIONS, NT_COLUMNS, require_columns
from edgelytics.workload.queries import QUERIES
from edgelytics.workload.tables import gold

NAN = float("nan")


def dominant(spark, *probabilities):
    df = spark.createDataFrame([(1, 1, 2, "FB", 1, *probabilities)], CONNECTIONS)
    return tuple(nt.with_dominant(df).select("dominant_score", "dominant_nt").first())


def test_dominant_labels(tiny):
    found = nt.with_dominant(tiny).orderBy("ord").select("dominant_nt", "dominant_score").collect()
    assert [r.dominant_nt for r in found] == [
        "GABA",
        "Acetylcholine",
        "GABA,Acetylcholine",
        "Glutamate",
        "Dopamine",
        "Serotonin",
        "",
        "GABA",
        "GABA",
    ]
    assert found[6].dominant_score is None and found[4].dominant_score == 0.7


def test_dominant_edge_cases(spark):
    everything = "GABA,Acetylcholine,Glutamate,Octopamine,Serotonin,Dopamine"
    assert dominant(spark, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) == (0.0, everything)
    assert dominant(spark, NAN, 0.2, 0.1, None, 0.2, 0.0) == (0.2, "Acetylcholine,Serotonin")
    assert dominant(spark, *[NAN] * 6) == (None, "")
    assert dominant(spark, *NONE6) == (None, "")


def test_missing_columns_fail_without_a_job(tiny):
    with pytest.raises(ValueError, match="ser_avg"):
        nt.with_dominant(tiny.drop("ser_avg"))
    assert require_columns(tiny, CONNECTIONS.names) is tiny


def test_nan_report_and_replacement(spark):
    df = spark.createDataFrame([(1, 1, 2, "FB", 1, NAN, 0.5, None, NAN, 0.0, NAN)] * 2, CONNECTIONS)
    counts = dict(rows(nt.nan_counts(df)))
    assert counts == dict(zip(NT_COLUMNS, [2, 0, 0, 2, 0, 2], strict=True))
    assert nt.nan_to_null(df).first()[5:] == (None, 0.5, None, None, 0.0, None)


def test_tokens_ties_and_explode(spark):
    texts = spark.createDataFrame([(" GABA , Dopamine",), ("",), (None,), ("GABA",)], "dominant_nt string")
    tokens = texts.select(nt.nt_tokens("dominant_nt").alias("t"), nt.is_tied().alias("tied"))
    assert rows(tokens) == sorted(
        [(["GABA", "Dopamine"], True), ([], False), (None, None), (["GABA"], False)], key=repr
    )
    assert [r[0] for r in rows(nt.explode_nt(texts), "nt")] == ["Dopamine", "GABA", "GABA"]
    assert [r[0] for r in rows(nt.explode_nt(texts, True), "nt")] == ["", "Dopamine", "GABA", "GABA"]


def test_vocabulary(spark):
    labels = spark.createDataFrame([("GABA",), ("Dopamine",), ("other",)], "nt string")
    assert rows(labels.select("nt", nt.vocabulary_rank(F.col("nt")))) == [
        ("Dopamine", 6),
        ("GABA", 1),
        ("other", None),
    ]


@pytest.mark.parametrize(
    ("flt", "kept"),
    [
        (EdgeFilter(), [1, 2, 3, 4, 5, 7, 8, 9]),
        (EdgeFilter(6), [3, 7, 8]),
        (EdgeFilter(neuropil="al_l"), [1, 3, 4, 8]),
        (EdgeFilter(neurotransmitter="gaba"), [1, 3, 8, 9]),
        (EdgeFilter(neurotransmitter="AMATE"), [4]),
        (EdgeFilter(5, "", ""), [1, 3, 7, 8]),
        (EdgeFilter(0, "%", None), []),
        (EdgeFilter(7, "acetyl", "AL_L"), [3]),
    ],
)
def test_filters(tiny, flt, kept):
    assert [r[0] for r in rows(nt.with_dominant(tiny).where(flt.condition), "ord")] == kept


def test_filter_arguments():
    assert EdgeFilter.resolve(2, "gab", "Dopamine", "", "FB") == EdgeFilter(2, "gab", "FB")
    assert EdgeFilter.resolve(neurotransmitter="", neuropil_choice="") == EdgeFilter()
    with pytest.raises(ValueError):
        EdgeFilter(-1)


def test_reports(tiny):
    gold = nt.with_dominant(tiny)
    per_region = [tuple(r) for r in reports.connections_per_neuropil(gold).collect()]
    assert per_region == [("AL_L", 4), ("FB", 3), (None, 1), ("AL_R", 1)]
    texts = dict(rows(reports.dominant_nt_distribution(gold)))
    assert texts["GABA"] == 3 and texts["GABA,Acetylcholine"] == 1 and texts[""] == 1
    means = [tuple(r) for r in reports.avg_dominant_score(gold).collect()]
    assert means[0] == ("Glutamate", 0.9) and means[-1] == ("", None)
    matrix = {r["neuropil"]: r for r in reports.neuropil_nt_matrix(gold).collect()}
    assert matrix["AL_L"]["GABA"] == 2 and matrix["FB"]["GABA"] == 0
    assert set(rows(reports.neuropil_nt_counts(gold))) >= {("AL_L", "GABA", 2), (None, "GABA", 1)}
    assert matrix["AL_L"]["GABA,Acetylcholine"] == 1 and matrix["FB"][""] == 1
    assert sum(n for r in matrix.values() for n in r[1:]) == len(TINY)
    texts = reports.label_texts()
    assert len(texts) == len(set(texts)) == 64 and len(next(iter(matrix.values()))) == 65


def test_schema_report(tiny):
    found = reports.schema_report(tiny).orderBy("position").collect()
    assert tuple(found[0]) == (0, "ord", "bigint", 9) and len(found) == len(tiny.columns)


@pytest.mark.parametrize("n", [0, 1, 7, 500, 1999, 2000, 5000])
def test_first_n_rows(spark, n):
    # Unevenly spread positions, far apart, and one that repeats.
    df = spark.range(2000).selectExpr("if(id between 400 and 420, 400, id) * id * 1000003 as ord", "id")
    expected = sorted((tuple(r) for r in df.collect()))[:n]
    assert sorted(tuple(r) for r in reports.first_n_rows(df, n).collect()) == expected


def test_first_n_of_tiny(tiny):
    assert [r[0] for r in rows(reports.first_n_rows(tiny, 4), "ord")] == [1, 2, 3, 4]
    assert reports.first_n_rows(tiny, 100).count() == len(TINY)


def test_tied_rows_make_the_text_once(spark, tmp_path):
    """Above the join the row maximum is made once; in a condition below it, once a label."""
    spark.range(40).selectExpr(
        "id % 20 as l_orderkey", "id * 3 as l_partkey", "id % 7 as l_suppkey", "cast(id % 4 as int) as l_linenumber",
        "double(id) as l_quantity", "'A' as l_returnflag", "'F' as l_linestatus",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(20).selectExpr("id as o_orderkey", "id + 5 as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    found = QUERIES["tied_rows"](spark, str(tmp_path))
    listed = rows(gold(spark, str(tmp_path)).select(found.columns))
    assert rows(found) == [r for r in listed if "," in r[-1]] and 0 < found.count() < 40
    assert found._jdf.queryExecution().optimizedPlan().toString().count("greatest(") == 1


def test_tied_rows_of_texts(spark):
    texts = spark.createDataFrame([("GABA,Dopamine",), ("",), (None,), ("GABA",)], "dominant_nt string")
    assert rows(nt.tied_rows(texts)) == [("GABA,Dopamine",)]
