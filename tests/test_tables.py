"""Intermediate tables and their removal."""
import os

import pytest

from snaptree import tables
from snaptree.operators import diff, dupes


def folders(spark):
    tables.shared_dir(spark)  # sets the folder
    return set(os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")))


def test_only_results_stay(spark):
    """Of a cleaned function its result stays, also in nested ones; if it fails nothing does."""
    rows = spark.range(5)

    @tables.cleaned
    def inner():
        return tables.saved(tables.saved(rows).where("id > 1"))

    @tables.cleaned
    def outer(fail=False):
        x = inner()
        if fail:
            raise RuntimeError("no")
        return x.unionByName(tables.saved(rows))

    before = folders(spark)
    out = outer()
    assert out.count() == 8 and len(folders(spark) - before) == 1
    with pytest.raises(RuntimeError):
        outer(fail=True)
    assert len(folders(spark) - before) == 1


def test_parted_tables_read_their_own_files(spark):
    t = tables.saved(spark.range(100).selectExpr("id", "cast(id % 5 as int) as k"), "k")
    assert t.columns == ["id", "k"] and t.where("k = 3").count() == 20 and len(t.where("k = 3").select("id", "k").inputFiles()) >= 1
    assert sorted(r.id for r in t.where("k = 3").collect()) == list(range(3, 100, 5))


def test_operators_leave_their_result_only(spark):
    files = spark.createDataFrame([(f"d{i % 3}/f{i % 4}", 1, f"h{i % 4}", None) for i in range(12)], "path string, size_bytes bigint, sha1 string, md5 string").dropDuplicates(["path"])
    before = folders(spark)
    dupes.duplicates(files).collect()
    diff.diff(files, files.where("path <> 'd1/f1'")).collect()
    assert len(folders(spark) - before) == 2
