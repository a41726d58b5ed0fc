"""Trail counts beside the listed trails."""

import random

import pytest
from pyspark.sql import functions as F

from edgelytics.functions.filters import EdgeFilter
from edgelytics.operators import hops
from edgelytics.operators.partners import store_roots
from edgelytics.operators.path_counts import count_trails
from edgelytics.schema import EDGES


def listed(edges, roots, k, flt, direction):
    found = {}
    for length, table in enumerate(hops.trails(edges, roots, k, flt, direction, ["neuropil"]), start=1):
        for r in table.groupBy("root_id").count().collect():
            found[r["root_id"], length] = r["count"]
    return found


@pytest.mark.parametrize(("k", "seed", "direction"), [(4, 1, hops.DOWNSTREAM), (3, 2, hops.UPSTREAM), (2, 3, hops.DOWNSTREAM)])
def test_as_many_as_are_listed(spark, k, seed, direction):
    """Few neurons, several regions, loops and edges back: every correction is needed."""
    rng = random.Random(seed)
    keys = {(rng.randrange(5), rng.randrange(5), f"r{rng.randrange(3)}") for _ in range(22)}
    keys |= {(0, 0, "r0"), (0, 0, "r1"), (0, 1, "r0"), (1, 0, "r2"), (7, 8, "r0")}
    df = spark.createDataFrame([(*key, rng.randrange(1, 9)) for key in sorted(keys)], "src long, dst long, neuropil string, syn_count int")
    rest = [f for f in EDGES.fields if f.name not in df.columns]
    edges = df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest])
    roots = store_roots(spark.createDataFrame([(0,), (1,), (7,), (8,), (99,)], "root_id long"))
    flt = EdgeFilter(threshold=2)
    want = listed(edges, roots, k, flt, direction)
    counted = count_trails(edges, roots, k, flt, direction).collect()
    got = {(r["root_id"], r["hops"]): r["rows"] for r in counted if r["rows"]}
    assert got == want and len(counted) == len({r[:2] for r in counted})
    assert max(n for _, n in want) == k and sum(want.values()) > 30
