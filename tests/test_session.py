"""Scratch folders: where they are, and that a run can remove its own."""

import os

import pytest

from uttermark import session


class FakeCluster:
    class conf:  # noqa: N801
        @staticmethod
        def get(name, default=None):
            return default

    class sparkContext:  # noqa: N801
        master, applicationId = "spark://host:7077", "app-1"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(FakeCluster)


def test_sized_tables_and_their_removal(spark):
    d = session.sized(spark.range(10), "ten")
    assert d.count() == 10
    folder = session._run_folder(spark)
    assert os.listdir(folder)
    session.clear_scratch(spark)
    assert not os.path.exists(folder)
