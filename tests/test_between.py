"""Trails between two sets of neurons beside the one-sided listing."""

import random

import pytest
from pyspark.sql import functions as F

from edgelytics.functions.filters import EdgeFilter
from edgelytics.operators import hops
from edgelytics.operators.between import _halves, _stored_roots, paths_between
from edgelytics.schema import EDGES


def dense(spark, seed, neurons, count):
    """Few neurons, several regions, a null region, loops and edges back."""
    rng = random.Random(seed)
    keys = {(rng.randrange(neurons), rng.randrange(neurons), f"r{rng.randrange(3)}") for _ in range(count)}
    keys |= {(0, 0, "r0"), (0, 0, "r1"), (0, 1, "r0"), (1, 0, "r2"), (70, 80, "r0")}
    made = [(*key, rng.randrange(1, 9)) for key in sorted(keys)] + [(1, 2, None, 5), (2, 1, None, 5)]
    df = spark.createDataFrame(made, "src long, dst long, neuropil string, syn_count int")
    rest = [f for f in EDGES.fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest]).cache()


def as_text(paths):
    listed = paths.select("root_id", "hops", F.to_json("nodes").alias("n"), F.to_json(F.struct("edges")).alias("e"))
    return sorted(tuple(r) for r in listed.collect())


@pytest.mark.parametrize(("k", "seed"), [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)])
def test_same_trails_as_from_one_end(spark, k, seed):
    edges = dense(spark, seed, 5, 11)
    sources, targets, flt = [0, 1, 3, 70, 99], [1, 2, 80, 98], EdgeFilter(threshold=3)
    want = hops.k_hop_downstream(edges, sources, k, flt).where(F.element_at("nodes", -1).isin(targets))
    got = paths_between(edges, sources, targets, k, flt)
    assert got.columns == ["root_id", "target_id", "hops", "nodes", "edges"]
    assert as_text(got) == as_text(want)
    assert k == 1 or want.where(f"hops = {k}").count() > 0


def test_ends_repeat_are_null_or_have_no_edge(spark):
    edges = dense(spark, 6, 6, 20)
    plain = as_text(paths_between(edges, [0, 1], [2], 3))
    table = spark.createDataFrame([(0,), (1,), (0,), (None,)], "root_id long")
    assert as_text(paths_between(edges, table, [2, 2], 3)) == plain and plain
    assert paths_between(edges, [99], [2], 3).count() == 0
    assert paths_between(edges, [0], [99], 3).count() == 0
    assert paths_between(edges.limit(0), [0], [1], 4).count() == 0
    for ends in ((None, [1]), ([1], None)):
        with pytest.raises(ValueError, match="both ends"):
            paths_between(edges, *ends)
    with pytest.raises(ValueError, match="between 1 and 5"):
        paths_between(edges, [0], [1], 6)


def test_fewer_trails_on_the_way(spark):
    """The two halves together list fewer trails than one end does."""
    edges, k = dense(spark, 7, 30, 200), 4
    one = sum(t.count() for t in hops.trails(edges, [0], k))
    starts, ends = _stored_roots(edges, [0]), _stored_roots(edges, [5])
    both = [*_halves(edges, starts, 2, EdgeFilter(), hops.DOWNSTREAM, None), *_halves(edges, ends, 2, EdgeFilter(), hops.UPSTREAM, None)]
    assert 5 * sum(t.count() for t in both) < one
