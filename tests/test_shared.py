"""Shared tables: where they go, and that scratch folders are deleted."""

import os

import pytest

from varspan import shared


class Conf:
    def __init__(self, master):
        self.values = {"spark.master": master}

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class Session:
    def __init__(self, master):
        self.conf = Conf(master)


def test_no_local_folder_on_a_cluster():
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]", ""):
        with pytest.raises(ValueError):
            shared.shared_dir(Session(master))
    for master in ("local", "local[4]"):
        session = Session(master)
        assert shared.shared_dir(session) == shared.shared_dir(session) == session.conf.get("spark.checkpoint.dir")


def test_scratch_tables_are_deleted(spark):
    with shared.scratch(spark) as folder:
        assert shared.written(spark.range(3)).count() == 3
        assert os.listdir(folder.removeprefix("file://"))
    assert not os.path.exists(folder.removeprefix("file://"))
    kept = shared.written(spark.range(3))
    assert kept.count() == 3
