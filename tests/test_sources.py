"""Scan, store, stream and imports, end to end on small files."""
import hashlib
import os
import sqlite3

import pytest

from snaptree.operators import basic, coverage
from snaptree.sources import legacy, scan, sqlite
from snaptree.sources.store import Store

pytestmark = pytest.mark.usefixtures("quick")


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "d").mkdir(parents=True)
    for name, text in (("a", "one"), ("d/b", "two"), ("d/empty", "")):
        (root / name).write_text(text)
    os.symlink(root / "a", root / "link")
    return root


def test_scan_resume_and_delete(spark, tmp_path, tree):
    store = Store(spark, f"file://{tmp_path}/store")
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    s = scan.snapshot(spark, store, str(tree), "first", md5=True)
    assert s["status"] == "completed" and s["hashes"] == ["sha1", "md5"]
    want = [(f"{tree}/a", "a", 3, sha("one")), (f"{tree}/d/b", "b", 3, sha("two")), (f"{tree}/d/empty", "empty", 0, sha(""))]
    assert rows(store.files(s), "path", "filename", "size_bytes", "sha1") == want
    assert basic.totals(store.files(s)).first() == (3, 6)
    (tree / "a").write_text("longer")
    have = store.files(s)
    assert rows(scan.unfinished(scan.listed(spark, str(tree)), have), "path") == [(f"{tree}/a",)]
    bare = scan.snapshot(spark, store, str(tree), "first", no_hash=True)
    assert bare["name"].startswith("first_") and bare["hashes"] == [] and bare["id"] == 2
    with pytest.raises(ValueError):
        store.free_name("first", exact=True)
    store.delete(s)
    store.delete(s)
    with pytest.raises(KeyError):
        store.resolve("first")
    assert store.files(s).count() == 0 and store.last_of_root(str(tree))["id"] == 2


def test_store_merge_and_copy(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    for name, files in (("x", [("/r/a", 1, "h1"), ("/r/b", 2, "h2")]), ("y", [("/r/b", 3, "h3"), ("/r/c", 4, None)])):
        s = store.create(name, "/r")
        store.write(s, spark.createDataFrame(files, "path string, size_bytes bigint, sha1 string"))
        store.write(s, spark.createDataFrame(files[:1], "path string, size_bytes bigint, sha1 string"))
        store.finish(s)
    m = store.merge(["x", "y"], "m")
    assert m["root_path"] == "/r" and rows(store.files(m), "path", "size_bytes") == [("/r/a", 1), ("/r/b", 3), ("/r/c", 4)]
    other = Store(spark, f"file://{tmp_path}/other")
    assert other.catalog().count() == 0
    c = other.copy_from(store, "m")
    assert rows(other.files(c), "path", "sha1") == rows(store.files(m), "path", "sha1") and c["status"] == "completed"
    tags = coverage.tagged(store.files(store.resolve("y")), [store.files(store.resolve("x"))])
    assert rows(tags, "path", "status") == [("/r/b", "uncovered"), ("/r/c", "no_hash")]


def test_legacy_text(spark, tmp_path):
    files = spark.createDataFrame([("/m/ü a", 5, "ab" * 16), ("/m/b", 7, None)], "path string, size_bytes bigint, md5 string")
    legacy.export(files, f"file://{tmp_path}/h", f"file://{tmp_path}/s")
    back = legacy.read(spark, f"file://{tmp_path}/h", f"file://{tmp_path}/s")
    assert rows(back, "path", "size_bytes", "md5") == [("/m/b", 7, None), ("/m/ü a", 5, "ab" * 16)] and legacy.common_root(back) == "/m"


def test_sqlite_import(spark, tmp_path):
    path = str(tmp_path / "old.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE snapshots (id INTEGER PRIMARY KEY, name TEXT, root_path TEXT, started_at TEXT, finished_at TEXT, status TEXT, hashes TEXT)")
        db.execute("CREATE TABLE files (id INTEGER PRIMARY KEY, snapshot_id INTEGER, path TEXT, filename TEXT, size_bytes INTEGER, mod_time TEXT, sha1 TEXT, md5 TEXT)")
        db.executemany("INSERT INTO snapshots VALUES (?, ?, ?, NULL, NULL, ?, 'sha1')", [(1, "tank/a", "/tmp/x-zfsscan-12", "completed"), (2, "gone", "/g", "deleted")])
        db.executemany("INSERT INTO files VALUES (?, 1, ?, 'f', 3, '2024-03-01T10:00:00Z', ?, '')", [(i, f"/tmp/x-zfsscan-12/f{i}", "AB" if i else "") for i in range(5)])
    store = Store(spark, f"file://{tmp_path}/store")
    done = sqlite.convert(spark, path, store)
    assert [(s["name"], s["root_path"], s["hashes"]) for s in done] == [("tank/a", "tank/a", ["sha1"])]
    assert rows(store.files(done[0]), "path", "sha1", "md5")[1] == ("tank/a/f1", "ab", None) and rows(store.files(done[0]).where("sha1 is null"), "path") == [("tank/a/f0",)]
    assert sqlite.convert(spark, path, store) == []


def test_stream(spark, tmp_path):
    from snaptree.streaming import follow

    store = Store(spark, f"file://{tmp_path}/store")
    s = store.create("s", "/r")
    for n in (1, 2):
        spark.createDataFrame([("/r/a", n, "h", None), (f"/r/{n}", n, "h", None)], "path string, size_bytes bigint, sha1 string, md5 string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        follow(spark, f"{tmp_path}/in", store, s, f"{tmp_path}/ck").awaitTermination()
    assert rows(store.files(s), "path", "size_bytes") == [("/r/1", 1), ("/r/2", 2), ("/r/a", 2)]


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 40


def test_sides_that_collide_are_refused(spark):
    side = lambda p: spark.createDataFrame([(p, 1, None, None)], "path string, size_bytes bigint, sha1 string, md5 string")
    assert rows(basic.combined([(side("/a/x"), "/a"), (side("/b/y"), "/b")]), "path") == [("x",), ("y",)]
    with pytest.raises(Exception, match="two sources hold the path x"):
        basic.combined([(side("/a/x"), "/a"), (side("/b/x"), "/b")]).collect()


def test_what_cannot_be_read_fails_a_scan(spark, tmp_path, tree, monkeypatch):
    """A directory that cannot be listed and a file that cannot be read are counted; nothing is left out silently."""
    store = Store(spark, f"file://{tmp_path}/store")
    (tree / "shut").mkdir()
    (tree / "shut" / "x").write_text("x")
    gone = tree / "d" / "gone"
    gone.write_text("g")

    def some(df):
        def broken(batches):
            for b in scan._list(os.lstat(tree).st_dev, "stay")(batches):
                hit = b.path.str.endswith("/shut/x")
                b.loc[hit, "error"] = "cannot be listed"
                yield b

        return df.mapInPandas(broken, f"{scan.LISTED}, error string, more boolean")

    root = spark.createDataFrame([(str(tree),)], "path string")
    found = some(root)
    assert found.where("error is not null").count() == 1
    real = scan.walked
    monkeypatch.setattr(scan, "walked", lambda *a: found.drop("more").unionByName(real(spark, str(tree / "nowhere"), "stay") if (tree / "nowhere").exists() else found.drop("more").where("false")))
    monkeypatch.setattr(scan, "saved", lambda df: (out := real_saved(df), gone.unlink(missing_ok=True))[0])
    real_saved = __import__("snaptree.tables", fromlist=["saved"]).saved
    s = scan.snapshot(spark, store, str(tree), "broken")
    assert s["status"] == "failed" and s["error_count"] == 2 and len(s["samples"]) == 2 and any("cannot be listed" in x for x in s["samples"]) and any("gone" in x for x in s["samples"])
    assert [r[0] for r in rows(store.files(s), "filename")] == ["a", "b", "empty"]


def test_a_missing_directory_is_an_error_row(tmp_path):
    """Listing goes on past what it cannot list."""
    import pandas as pd

    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "f").write_text("1")
    device = os.lstat(tmp_path).st_dev
    out = pd.concat(scan._list(device, "stay")(iter([pd.DataFrame({"path": [str(tmp_path / "nowhere"), str(tmp_path / "ok")]})])))
    assert out.error.notna().tolist() == [True, False] and out.path.tolist()[1].endswith("ok/f")
    with pytest.raises(OSError, match="another file system"):
        list(scan._list(device + 1, "fail")(iter([pd.DataFrame({"path": [str(tmp_path)]})])))
    assert len(pd.concat(scan._list(device + 1, "stay")(iter([pd.DataFrame({"path": [str(tmp_path)]})])))) == 0


def test_scans_are_gone_on_with(spark, tmp_path, tree, monkeypatch):
    """An interrupted scan leaves what it has hashed; the next one reads the rest alone; force_new starts another."""
    store = Store(spark, f"file://{tmp_path}/store")
    for i in range(20):
        (tree / f"more{i}").write_text(str(i))
    monkeypatch.setattr(scan, "FILES_PER_WRITE", 4)
    real, calls = scan.hashed, []

    def dies(files, md5=False):
        if sum(calls):
            raise KeyboardInterrupt
        calls.append(files.count())
        return real(files, md5)

    monkeypatch.setattr(scan, "hashed", dies)
    with pytest.raises(KeyboardInterrupt):
        scan.snapshot(spark, store, str(tree), "s")
    left = store.last_of_root(str(tree))
    have = store.files(left).count()
    assert left["status"] == "in_progress" and 0 < have == sum(calls) < 23
    seen = []
    monkeypatch.setattr(scan, "hashed", lambda files, md5=False: (seen.append(files.count()), real(files, md5))[1])
    done = scan.snapshot(spark, store, str(tree), "s")
    assert done["id"] == left["id"] and done["status"] == "completed" and store.files(done).count() == 23 and sum(seen) == 23 - have
    half = store.create("s2", str(tree))
    new = scan.snapshot(spark, store, str(tree), "s2", force_new=True, record_as=None)
    assert new["id"] != half["id"] and new["name"] == "s2" and store.resolve(str(half["id"]))["name"] == f"s2_superseded_{half['id']}"
    store.finish(store.resolve(str(half["id"])), errors=1)
    with pytest.raises(ValueError, match="cannot be resumed"):
        scan.snapshot(spark, store, str(tree), "s2", resume_from=str(half["id"]))
    kept = scan.snapshot(spark, store, str(tree), "as", no_hash=True, record_as="tank/x")
    assert kept["root_path"] == "tank/x" and rows(store.files(kept), "path")[:3] == [("tank/x/a",), ("tank/x/d/b",), ("tank/x/d/empty",)]
    assert scan.estimate(str(tree)) > 0 and scan.estimate("/", cross=True) >= scan.estimate("/")


def test_conversion_keeps_what_snapshots_say(spark, tmp_path):
    """Unfinished and failed snapshots stay so, with their dates; an interrupted conversion is finished by the next one."""
    path = str(tmp_path / "old.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE snapshots (id INTEGER PRIMARY KEY, name TEXT, root_path TEXT, started_at TEXT, finished_at TEXT, status TEXT, hashes TEXT, error_count INTEGER)")
        db.execute("CREATE TABLE files (id INTEGER PRIMARY KEY, snapshot_id INTEGER, path TEXT, size_bytes INTEGER, sha1 TEXT)")  # an older layout
        t = "2020-05-06T07:08:09Z"
        db.executemany("INSERT INTO snapshots VALUES (?, ?, '/r', ?, ?, ?, 'sha1', ?)", [(1, "wip", t, None, "in_progress", 0), (2, "bad", t, t, "failed", 3), (3, "good", t, t, "completed", 0)])
        db.executemany("INSERT INTO files (snapshot_id, path, size_bytes, sha1) VALUES (?, ?, 1, 'ab')", [(s, f"/r/f{i}") for s in (1, 2, 3) for i in range(s)])
    store = Store(spark, f"file://{tmp_path}/store")
    # a conversion that died before it was whole
    store.write(store.create("good", "/r", "convert:3"), spark.createDataFrame([("/r/f0", 1)], "path string, size_bytes bigint"))
    done = sqlite.convert(spark, path, store)
    assert [(s["name"], s["status"], s["error_count"]) for s in done] == [("wip", "in_progress", 0), ("bad", "failed", 3), (done[2]["name"], "completed", 0)]
    now = store.catalog().where("status <> 'deleted'").orderBy("id").collect()
    assert len(now) == 3 and all(str(r.started_at) == "2020-05-06 07:08:09" for r in now) and now[0].finished_at is None and str(now[1].finished_at) == "2020-05-06 07:08:09"
    assert [store.files(r.asDict()).count() for r in now] == [1, 2, 3] and store.files(now[0].asDict()).first()["filename"] == "f0"
    assert sqlite.convert(spark, path, store) == [] and store.catalog().where("status <> 'deleted'").count() == 3
    assert store.warnings(now[0].asDict(), now[2].asDict()) == ["wip is in_progress"]


def test_stores_as_a_whole(spark, tmp_path):
    """All snapshots are copied; counters of merges; layouts; clashes; names."""
    a, b = Store(spark, f"file://{tmp_path}/a"), Store(spark, f"file://{tmp_path}/b")
    for name, files in (("x", [("/r/a", 1, "h1"), ("/r/b", 2, "h2")]), ("y", [("/r/b", 3, "h3"), ("/s/c", 4, None)])):
        s = a.create(name, "/r")
        a.write(s, spark.createDataFrame(files, "path string, size_bytes bigint, sha1 string"))
        a.finish(s)
    gone = a.create("gone", "/r")
    a.delete(gone)
    assert [r["name"] for r in b.copy_all(a)] == ["x", "y"] and b.catalog().count() == 2 and [r["name"].startswith("x_") for r in b.copy_all(a)] == [True, False]
    m = a.merge(["x", "y"], "m")
    assert (m["n_records"], m["n_unique"], m["n_collapsed"], m["n_conflicts"], m["samples"]) == (4, 3, 1, 1, ["/r/b"])
    apart = a.create("z", "/q")
    a.write(apart, spark.createDataFrame([("/q/1", 1, "h")], "path string, size_bytes bigint, sha1 string"))
    a.finish(apart)
    m2 = a.merge(["x", "z"], "m2")
    assert (m2["n_records"], m2["n_conflicts"]) == (3, 0) and a.files(m2).count() == 3
    bad = a.create("bad", "/r")
    a.write(bad, spark.createDataFrame([("/r/d", 1, "h"), ("/r/d/e/f", 1, "h")], "path string, size_bytes bigint, sha1 string"))
    with pytest.raises(ValueError, match="r/d is a file and a directory"):
        a.finish(bad)
    spark.createDataFrame([(99,)], "layout int").write.mode("overwrite").parquet(f"file://{tmp_path}/a/layout")
    with pytest.raises(ValueError, match="layout 99"):
        Store(spark, f"file://{tmp_path}/a")


def test_datasets_are_scanned_by_plan(spark, tmp_path, tree):
    from contextlib import contextmanager

    from snaptree.sources import zfs

    store = Store(spark, f"file://{tmp_path}/store")
    text = spark.createDataFrame([(f"{n}\t/{n}\tyes\ton\t{t}\t1",) for n, t in (("tank/a", "filesystem"), ("tank/b", "filesystem"), ("tank/v", "volume"))], "value string")

    @contextmanager
    def mounted(name):
        if name == "tank/b":
            raise OSError("cannot be mounted")
        yield str(tree)

    out = zfs.scan(spark, store, zfs.parse(text), mounted, no_hash=True)
    assert [(r["name"], r["plan"], r["outcome"]) for r in out] == [("tank/a", "scan", "completed"), ("tank/b", "scan", "error: cannot be mounted"), ("tank/v", "volume", "skipped")]
    assert store.last_of_root("tank/a")["status"] == "completed" and rows(store.files(store.last_of_root("tank/a")), "path")[0] == ("tank/a/a",)
    assert zfs.scan(spark, store, zfs.parse(text), mounted, no_hash=True)[0]["plan"] == "already_done"
