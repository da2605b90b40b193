"""Joins that split hot keys give what plain joins give, wherever the line between hot and other keys lies."""

import pytest
from pyspark.sql import functions as F

from townwire.llm import common


@pytest.mark.parametrize("share", [1, 4, 2_000])
def test_join_counted(spark, monkeypatch, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rows = spark.createDataFrame([(k % 3, k % 2, k) for k in range(30)] + [(7, 0, k) for k in range(40)] + [(9, 9, 99)], "a int, b int, v int")
    both = rows.groupBy("a", "b").agg(F.count("*").alias("n")).filter("a <> 9")
    got = sorted(map(tuple, common.join_counted(rows, both, ["a", "b"], "n", 70).select("a", "b", "v", "n").collect()))
    assert got == sorted(map(tuple, rows.join(both, ["a", "b"]).select("a", "b", "v", "n").collect())) and len(got) == 70


def test_scratch_tables_are_cleared(spark):
    from pathlib import Path

    from townwire.llm import common

    with common.cleared(spark):
        t = common.stored(spark.range(3), "x")
        folder = Path(t.inputFiles()[0].removeprefix("file://")).parent
        assert t.count() == 3 and folder.exists()
    assert not folder.exists()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from townwire.llm import common
    from townwire.plans.registry import scratch

    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077"))
    for root in (common.scratch_root, scratch):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            root(cluster)
