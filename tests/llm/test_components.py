import numpy as np
import pytest

from edgelytics.llm.components import components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is None or b is None:
            if a is not None:
                find(a)
            continue
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return sorted((x, find(x)) for x in root)


def random_edges(seed):
    rng = np.random.default_rng(seed)
    return [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))]


@pytest.mark.parametrize(
    "edges",
    [
        [(k, k + 1) for k in range(40)],  # a chain
        [(0, k) for k in range(1, 50)] + [(99, 100), (100, 99), (7, 7), (200, 200)],  # a hub, repeats, loops
        random_edges(1),
        random_edges(2),
    ],
)
def test_as_union_find(spark, edges):
    found = components(spark.createDataFrame(edges, "x long, y long"), "x", "y")
    known = [(a, b) for a, b in edges]
    assert sorted(map(tuple, found.collect())) == brute(known)


def test_nulls_and_nothing(spark):
    found = components(spark.createDataFrame([(None, 1), (2, 3), (3, None)], "x long, y long"), "x", "y")
    assert sorted(map(tuple, found.collect())) == [(2, 2), (3, 2)]
    assert components(spark.createDataFrame([], "x string, y string"), "x", "y").count() == 0
