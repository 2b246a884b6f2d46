import pytest

from parlance.session import SCALE_CONF, apply_conf, fresh_path, local_path, shared_dir


def test_shared_dir_is_the_session_checkpoint_dir(spark):
    base = shared_dir(spark)
    assert base == spark.sparkContext.getCheckpointDir()
    a, b = fresh_path(spark, "x"), fresh_path(spark, "x")
    assert a != b and a.startswith(base.rstrip("/") + "/x-")


def test_apply_conf_keeps_the_sessions_own_settings(spark):
    key = "spark.sql.adaptive.skewJoin.enabled"
    spark.conf.set(key, "false")
    try:
        apply_conf(spark)
        assert spark.conf.get(key) == "false"
        apply_conf(spark, overwrite=True)
        assert spark.conf.get(key) == SCALE_CONF[key]
    finally:
        spark.conf.set(key, "true")


def test_local_path():
    assert local_path("file:/tmp/a/b") == "/tmp/a/b"
    assert local_path("file:///tmp/a") == "/tmp/a"
    assert local_path("/tmp/a/") == "/tmp/a"


class _Context:
    def __init__(self, master):
        self.master, self.dir = master, None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Session:
    """A session without spark.checkpoint.dir, on a master of our choice."""

    def __init__(self, master):
        self.sparkContext = _Context(master)
        self.conf = {}


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"])
def test_no_local_folder_off_a_local_master(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Session(master))


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4,2]"])
def test_local_folder_on_a_local_master(master):
    assert "parlance-ckpt-" in shared_dir(_Session(master))
