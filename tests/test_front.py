"""Whole operations over a store."""
import datetime as dt
import itertools

import pytest

from snaptree import front
from snaptree.operators import basic, coverage, diff
from snaptree.sources.store import Store

FILES = "path string, size_bytes bigint, sha1 string, md5 string"

pytestmark = pytest.mark.usefixtures("quick")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, f"file://{tmp_path_factory.mktemp('front')}/store")

    def put(name, root, files, status="completed", hashes=("sha1", "md5")):
        facts = {"name": name, "root_path": root, "computer_name": "c", "started_at": dt.datetime(2024, 1, 1), "finished_at": dt.datetime(2024, 1, 2), "status": status, "hashes": list(hashes), "error_count": int(status == "failed")}
        return s.take(spark.createDataFrame([(f"{root}/{p}", n, h if "sha1" in hashes else None, h if "md5" in hashes else None) for p, n, h in files], FILES), facts)

    put("old", "/o", [("a/1", 10, "h1"), ("a/2", 20, "h2"), ("b/3", 30, "h3"), ("b/4", 40, None), ("tmp/5", 50, "h5"), ("tmp/6", 5, "h6")])
    put("new", "/n", [("a/1", 10, "h1"), ("c/2", 20, "h2"), ("b/3", 31, "h9")])
    put("part", "/p", [("tmp/5", 50, "h5")], status="failed")
    put("md5 only", "/m", [("a/1", 10, "h1")], hashes=("md5",))
    put("sha1 only", "/m", [("a/1", 10, "h1")], hashes=("sha1",))
    put("none", "/z", [("a/1", 10, "h1")], hashes=())
    put("empty", "/e", [], hashes=())
    return s


def test_a_diff_by_names(store):
    r = front.compare(store, ["old"], ["new"])
    assert r.hash_type == "sha1" and r.warnings == []
    told = [(q.status, q.path, q.source_path) for q in r.rows.orderBy("line_no").collect()]
    assert told == [("Modified", "/o/b/", None), ("Move", "/n/c/2", "/o/a/2"), ("Removed", "/o/tmp/", None)] or {t[0] for t in told} == set(r.figures)
    assert sum(r.figures.values()) == len(told)
    update = front.compare(store, ["old"], ["new"], excludes=["tmp"], update=True).rows.collect()
    assert {q.status for q in update} <= {"Removed", "Modified"} and not any("tmp" in q.path for q in update)


def test_hashes_are_agreed_on(store):
    assert front.compare(store, ["old"], ["md5 only"]).hash_type == "md5"
    for a, b in ((["md5 only"], ["sha1 only"]), (["old"], ["none"]), (["old"], ["empty"])):
        with pytest.raises(ValueError, match="share no hash"):
            front.compare(store, a, b)
    with pytest.raises(ValueError):
        front.compare(store, [], ["new"])
    with pytest.raises(KeyError):
        front.compare(store, ["old"], ["nowhere"])


def test_warnings_of_snapshots_that_are_not_whole(store):
    assert front.compare(store, ["old"], ["part"]).warnings == ["part is failed"]
    assert front.covered(store, "part", ["old"]).warnings == ["part is failed"]


def test_several_snapshots_make_a_side(store, spark):
    """A diff against two snapshots is that against their merge, if they share no path; else it is refused."""
    both = front.compare(store, ["old"], ["new", "part"])
    merged = basic.combined([(store.files(store.resolve(n)), store.resolve(n)["root_path"]) for n in ("new", "part")])
    want = diff.diff(basic.relativised(store.files(store.resolve("old")), "/o"), merged, "/o", "")
    assert sorted(map(tuple, both.rows.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    with pytest.raises(Exception, match="two sources hold the path"):
        front.compare(store, ["old"], ["new", "md5 only"]).rows.collect()


def test_coverage_by_names(store):
    r = front.covered(store, "old", ["new", "part", "empty"])
    assert r.hash_type == "sha1" and [(q.path, q.status) for q in r.rows.collect()] == [("/o/b/3", "uncovered"), ("/o/tmp/6", "uncovered")]
    f = r.figures
    assert (f["n_files"], f["n_covered"], f["n_uncovered"], f["n_no_hash"], f["bytes_uncovered"], f["excluded"]) == (6, 3, 2, 1, 35, 0) and f["loss"]
    assert (f["listed"], f["unlisted"]) == (2, 0)
    one = front.covered(store, "old", ["new", "part"], limit=1)
    assert [q.path for q in one.rows.collect()] == ["/o/b/3"] and (one.figures["listed"], one.figures["unlisted"], one.figures["n_uncovered"]) == (1, 1, 2)
    assert [tuple(q) for q in front.covered(store, "old", ["new"], by_dir=True, limit=0).rows.collect()] == [("/o/b", 2, 70), ("/o/tmp", 2, 55)]
    assert front.covered(store, "new", ["old"], min_size=40).figures["n_files"] == 0
    assert not front.covered(store, "part", ["old"]).figures["loss"]


def test_modes_of_excluding(store):
    whole = front.covered(store, "old", ["new"], excludes=["tmp", "/o/b/4"])
    assert (whole.figures["n_files"], whole.figures["excluded"], whole.figures["n_uncovered"], whole.figures["n_no_hash"]) == (3, 3, 1, 0)
    lost = front.covered(store, "old", ["new"], excludes=["tmp", "a"], exclude_mode="uncovered")
    assert (lost.figures["n_files"], lost.figures["excluded"], lost.figures["n_covered"], lost.figures["n_uncovered"]) == (4, 2, 2, 1)
    with pytest.raises(ValueError):
        front.covered(store, "old", ["new"], exclude_mode="some")


def test_coverage_that_makes_no_sense_is_refused(store):
    for args, kw in ((("old", ["old"]), {}), (("old", []), {}), (("old", ["new"]), {"rollup": True, "by_dir": True}), (("md5 only", ["sha1 only"]), {}), (("none", ["old"]), {})):
        with pytest.raises(ValueError):
            front.covered(store, *args, **kw)
    r = front.covered(store, "empty", ["none"])
    assert r.rows is None and not r.figures["loss"] and r.figures["n_files"] == 0
    # a keeper without any hash holds nothing, and keeps no other one from being asked
    assert front.covered(store, "md5 only", ["none", "old"]).hash_type == "md5"


def test_report_folds_covered_directories(spark):
    rows = [(f"/r/ok{i}/f{k}", 1, "covered") for i in range(3) for k in range(i + 1)] + [("/r/bad/x", 2, "uncovered"), ("/r/bad/y", 3, "no_hash")] + [(f"/r/mix/u{k}", 5, "uncovered") for k in range(5)] + [("/r/mix/c", 7, "covered"), ("/r/one/c", 1, "covered"), ("/r/one/u", 9, "uncovered")]
    tags = spark.createDataFrame(rows, "path string, size_bytes bigint, status string")
    got = {(q.path, q.kind): (q.n_covered, q.n_uncovered, q.n_no_hash, q.n_bytes, q.n_dirs) for q in coverage.report(tags, 3).collect()}
    assert got[("r", "folded")] == (6, 0, 0, 6, 3) and not any(k == "covered" for _, k in got)
    assert got[("r", "summary")] == (8, 7, 1, 53, 0) and got[("r/bad", "not_covered")] == (0, 1, 1, 5, 0)
    assert got[("r/mix", "summary")] == (1, 5, 0, 32, 0) and got[("r/one", "listed")] == (1, 1, 0, 10, 0)
    assert got[("r/one/u", "uncovered")] == (0, 1, 0, 9, 0) and sum(k == "uncovered" for _, k in got) == 6
    assert list(itertools.chain(coverage.report(tags.limit(0)).collect())) == []


def test_duplicates_and_listing(store):
    r = front.duplicates(store, "old")
    assert r.figures == {"n_groups": 0, "wasted_bytes": 0}
    text = front.listing(store).split("\n")
    assert text[0].split()[:3] == ["ID", "Name", "Status"] and any("failed (1 error)" in line for line in text) and len(text) == 9
