from __future__ import annotations

import os

import pytest

from stockbook import session
from stockbook.session import clear_scratch, scratch_path, shared_dir


def test_shared_dir_is_the_sessions_checkpoint_dir(spark):
    base = shared_dir(spark)
    assert base == spark.sparkContext.getCheckpointDir()
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a.startswith(base.rstrip("/") + "/x-") and a != b


class _Context:
    """A session on a cluster master without the setting."""

    master = "spark://host:7077"

    def getCheckpointDir(self):  # noqa: N802
        return None

    def getConf(self):  # noqa: N802
        return {}


class _Session:
    sparkContext = _Context()  # noqa: N815
    conf = {}


def test_a_cluster_must_name_the_shared_folder():
    with pytest.raises(RuntimeError):
        shared_dir(_Session())


def test_scratch_is_cleared(spark, monkeypatch):
    monkeypatch.setattr(session, "_scratch", [])
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file:")
    assert os.path.isdir(local)
    assert clear_scratch(spark) == 1
    assert not os.path.exists(local)
