"""Physical plans: where work is shuffled, pruned, split."""

import pytest
from pyspark.sql import functions as F

from edgelytics.functions.transmitters import with_dominant
from edgelytics.operators import edges as eg
from edgelytics.operators import histogram as hg
from edgelytics.operators import hops, hub_join
from edgelytics.schema import EDGES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def settings(spark):
    changed = []

    def change(**conf):
        for key, value in conf.items():
            changed.append(key)
            spark.conf.set(key, value)

    yield lambda conf: change(**conf)
    for key in changed:
        spark.conf.unset(key)


def test_edges_are_hash_aggregated(tiny):
    text = plan(eg.latest_edges(tiny))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    assert text.count("Exchange") == 1 and "partial_max_by" in text


def test_cube_needs_one_shuffle(tiny):
    text = plan(hg.connection_cube(with_dominant(tiny)))
    assert text.count("Exchange") == 1 and "Generate" not in text
    assert "partial_count" in text and "SortAggregate" not in text


def test_unique_ids_need_one_shuffle_of_ids(tiny, spark):
    text = plan(hg.unique_counts(tiny, spark.createDataFrame([("A",)], "neuropil string")))
    assert text.count("hashpartitioning(id") == 1 and "Expand" not in text


def hub_edges(spark, count=60_000):
    """A third of all edges leave neuron 0; the others are spread."""
    ids = spark.range(0, count, 1, 8)
    hub = F.col("id") % 3 == 0
    df = ids.select(
        F.when(hub, 0).otherwise(1 + F.col("id") % 20_011).alias("src"),
        F.when(hub, 100_000 + F.col("id")).otherwise(F.col("id") % 19_997).alias("dst"),
        F.concat(F.lit("region_"), F.col("id") % 7).alias("neuropil"),
        (1 + F.col("id") % 50).cast("int").alias("syn_count"),
    )
    rest = [f for f in EDGES.fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest])


def test_hub_output_is_spread_under_default_settings(spark, settings, monkeypatch):
    """A hub of thousands of edges in and out, and what each task makes of it."""
    monkeypatch.setattr(hub_join, "CELL_ROWS", 50_000)
    settings({"spark.sql.shuffle.partitions": "64"})
    ends = spark.range(3_000).select((F.col("id") + 10).alias("far"))
    into = ends.select(F.col("far").alias("src"), F.lit(1).cast("bigint").alias("dst"))
    out = ends.select(F.lit(1).cast("bigint").alias("src"), (F.col("far") + 5_000).alias("dst"))
    df = into.union(out).select("src", "dst", F.lit("R").alias("neuropil"), F.lit(3).alias("syn_count"))
    rest = [f for f in EDGES.fields if f.name not in df.columns]
    edges = df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest])
    found = hops.two_hop_downstream(edges).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in found) == 9_000_000
    assert max(r["count"] for r in found) <= 10 * 50_000
    ids = hops.two_hop_downstream(edges).select("post2_id", "root_id").distinct().count()
    assert ids == 9_000_000


def test_ordinary_neurons_are_not_cut(spark):
    edges = hub_edges(spark, 3_000)
    assert "Generate" not in plan(hops.two_hop_downstream(edges))


def test_trails_are_written_once_per_hop(spark):
    edges = hub_edges(spark, 300)
    by_length = hops.trails(edges, [1, 2, 3], 3)
    for earlier in by_length[:-1]:
        assert "FileScan parquet" in plan(earlier) and "Join" not in plan(earlier)
    assert plan(by_length[-1]).count("Join") == 1


def even_edges(spark, neurons=1_000, degree=6):
    """Every neuron sends and receives as much as any other."""
    ids = spark.range(neurons).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(degree))).alias("n"))
    far = (F.col("src") * 7 + F.col("n") * F.col("n") * 31) % neurons
    df = ids.select("src", far.alias("dst"), F.concat(F.lit("R"), F.col("n")).alias("neuropil"), F.lit(3).alias("syn_count"))
    rest = [f for f in EDGES.fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest])


@pytest.mark.parametrize("known", [True, False])
def test_reached_neurons_are_combined_in_tasks_of_bounded_size(spark, monkeypatch, known):
    """No neuron is a hub, but a hop makes more pairs than one task should hold."""
    monkeypatch.setattr(hub_join, "CELL_ROWS", 2_000)
    edges = even_edges(spark)
    degrees = eg.degrees(edges) if known else None
    found = hops.k_hop_nodes(edges, k=2, degrees=degrees)
    # one shuffle of all pairs, none of them held before it
    assert "partial_max" not in plan(found) and plan(found).count("Join") == 2
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == found.distinct().count() > 50_000
    assert max(sizes) <= 4 * 2_000


def test_circuits_shuffle_lists_of_roots(spark, monkeypatch):
    """Not a row for each root and edge, of which there are many times more than edges."""
    monkeypatch.setattr(hub_join, "CELL_ROWS", 2_000)
    edges = even_edges(spark, 300)
    found = hops.circuit(edges, k=2, degrees=eg.degrees(edges))
    text = plan(found)
    assert "array_intersect" in text and "hashpartitioning(root_id" not in text
    assert found.count() > 20 * edges.count()


def test_edges_are_worded_once(spark):
    """Below the join: as text, a trail only joins the words of its edges."""
    edges = even_edges(spark, 100)
    text = plan(hops.k_hop_downstream(edges, k=2, text=True).where("hops = 2"))
    above = text[: text.index("Join")]
    assert "concat_ws" in above and "struct" not in above
