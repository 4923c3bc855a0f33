"""The folder that all executors share."""

from types import SimpleNamespace

import pytest

from labelloom.session import shared_dir


def stub(master, setting=None, checkpoint=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: setting if key == "spark.checkpoint.dir" else default),
                           sparkContext=SimpleNamespace(getCheckpointDir=lambda: checkpoint, master=master))


def test_a_cluster_must_name_its_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(stub(master))
        assert shared_dir(stub(master, setting="hdfs:/a")) == "hdfs:/a"
        assert shared_dir(stub(master, checkpoint="hdfs:/b")) == "hdfs:/b"
