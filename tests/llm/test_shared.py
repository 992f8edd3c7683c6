from types import SimpleNamespace

import pytest

from tensorloom.llm._shared import discard, materialise, shared_dir


def session(master, folder=None):
    context = SimpleNamespace(master=master, getConf=lambda: {}, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: folder))


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_dir(session(master))
        assert shared_dir(session(master, "hdfs://a/b/")) == "hdfs://a/b"
    for master in ("local", "local[*]", "local[4,2]"):
        assert shared_dir(session(master)).startswith("file:///")


def test_discard(spark):
    df = materialise(spark.range(5), "x")
    assert df.count() == 5
    discard(df), discard(df), discard(spark.range(1))
