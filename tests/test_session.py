"""Where intermediate tables go."""

import pytest

from edgelytics.session import scratch_dir


class FakeSession:
    def __init__(self, **conf):
        self.settings = {"spark.app.id": "app-1"} | conf
        self.conf = self
        self.sparkContext = self

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def getCheckpointDir(self):
        return self.settings.get("context")


def test_shared_folder_from_the_session():
    shared = FakeSession(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///tmp/x/"})
    assert scratch_dir(shared) == "hdfs:///tmp/x/edgelytics-app-1"
    assert scratch_dir(FakeSession(context="s3a://b/c")) == "s3a://b/c/edgelytics-app-1"


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(FakeSession(**{"spark.master": "spark://host:7077"}))


def test_local_mode_gets_a_folder_of_its_own():
    local = FakeSession(**{"spark.master": "local[2]", "spark.app.id": "app-local"})
    assert scratch_dir(local) == scratch_dir(local)
