"""The shared folder: read from the session, one of its own only for a local session."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from lakeloom import shared


def session(master, folder=None):
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)), setCheckpointDir=lambda where: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_an_unset_folder_is_an_error_on_a_cluster(master):
    with pytest.raises(shared.SharedFolderError, match="spark.checkpoint.dir"):
        shared.shared_folder(session(master))


def test_the_named_folder_is_used():
    assert shared.shared_folder(session("yarn", "s3a://bucket/tmp/")) == "s3a://bucket/tmp"
    assert shared.shared_folder(session("local[2]")).startswith("file:///")


def test_folders_are_remembered_until_dropped(spark):
    path = shared.scratch_folder(spark, "some")
    spark.range(3).write.parquet(path)
    assert (spark, path) in shared._made and spark.read.parquet(path).count() == 3
    shared.drop_folder(spark, path)
    assert (spark, path) not in shared._made
