"""Shared folders and their tables."""

from types import SimpleNamespace

import pytest

from foldspark.sources import staging


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


def test_folder_is_the_session_s():
    assert staging.shared_folder(session("yarn", "hdfs://a/b/")) == "hdfs://a/b"


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "k8s://h", "local-cluster[3,2,3000]"])
def test_no_local_folder_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_path(session(master), "x")


def test_local_folder_of_our_own():
    assert staging.shared_folder(session("local[4]")).startswith("file:///")
    assert staging.shared_path(session("local"), "x") != staging.shared_path(session("local"), "x")


def test_discard(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    staging.discard(spark, path, str(tmp_path / "none"))
    assert not (tmp_path / "t").exists()
