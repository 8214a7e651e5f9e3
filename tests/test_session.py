"""The shared folder: the session's setting wins; no local fallback on a cluster."""

import pytest

from jobscope.session import CLUSTER_CONF, apply_conf, scratch_path, shared_dir


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master, ckpt=None):
        self.master, self.ckpt = master, ckpt

    def getCheckpointDir(self):
        return self.ckpt

    def setCheckpointDir(self, d):
        self.ckpt = d


class _Session:
    def __init__(self, master, conf=None, ckpt=None):
        self.sparkContext = _Context(master, ckpt)
        self.conf = _Conf(conf or {})


def test_cluster_without_checkpoint_dir_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Session("yarn"))


def test_session_setting_wins():
    s = _Session("yarn", conf={"spark.checkpoint.dir": "hdfs:///shared/ckpt/"})
    assert shared_dir(s) == "hdfs:///shared/ckpt"
    assert s.sparkContext.getCheckpointDir() == "hdfs:///shared/ckpt/"
    assert scratch_path(s, "x").startswith("hdfs:///shared/ckpt/x-")


def test_local_session_gets_a_temporary_folder():
    s = _Session("local[2]")
    d = shared_dir(s)
    assert d and s.sparkContext.getCheckpointDir() == d


def test_cluster_conf_applies_runtime_settings(spark):
    keys = [k for k in CLUSTER_CONF if k != "spark.sql.shuffle.partitions"]
    saved = {k: spark.conf.get(k, None) for k in keys}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        apply_conf(spark, {k: CLUSTER_CONF[k] for k in keys})
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(256 << 20)
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
