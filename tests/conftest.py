import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from edgelytics.operators.edges import latest_edges  # noqa: E402
from edgelytics.schema import CONNECTIONS  # noqa: E402
from edgelytics.session import get_session, release_scratch  # noqa: E402

NONE6 = (None,) * 6

# ord, pre, post, neuropil, syn_count, six probabilities
TINY = [
    (1, 1, 2, "AL_L", 5, 0.9, 0.1, 0.0, 0.0, 0.0, 0.0),
    (2, 1, 2, "AL_R", 3, 0.1, 0.8, 0.1, 0.0, 0.0, 0.0),
    (3, 2, 3, "AL_L", 7, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0),
    (4, 3, 1, "AL_L", 2, 0.0, 0.0, 0.9, 0.0, 0.0, 0.0),
    (5, 3, 3, "FB", 4, 0.0, 0.0, 0.0, 0.0, 0.0, 0.7),
    (6, 2, 4, "FB", None, 0.2, 0.1, 0.0, 0.0, 0.6, 0.0),
    (7, 4, 5, "FB", 6, *NONE6),
    (8, 1, 2, "AL_L", 9, 0.9, 0.1, 0.0, 0.0, 0.0, 0.0),
    (9, 5, 1, None, 1, 0.3, 0.0, 0.0, 0.0, 0.0, 0.0),
]


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.sql.maxMetadataStringLength": "1000",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def tiny(spark):
    return spark.createDataFrame(TINY, CONNECTIONS)


@pytest.fixture(scope="session")
def tiny_edges(tiny):
    return latest_edges(tiny)


def rows(df, *columns):
    """The rows of a small result as sorted tuples."""
    found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(found, key=repr)
