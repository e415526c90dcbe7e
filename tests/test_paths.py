import pytest
from pyspark.sql import functions as F

from snaptree.functions import paths, values


def test_under_and_excluded(spark):
    rows = [("/a/b/c", "/a/b", True), ("/a/bc", "/a/b", False), ("/a/b", "/a/b/", True), ("/x", "/", True), ("x", "/", False), ("/a", "", False), ("a/b", "a", True), ("/a//b", "/a", True)]
    for p, prefix, want in rows:
        got = spark.range(1).select(paths.under(F.lit(p), prefix).alias("x")).first()["x"]
        assert got is want, (p, prefix)
    ex = lambda p, xs: spark.range(1).select(paths.excluded(F.lit(p), "/mnt/r", xs).alias("x")).first()["x"]
    assert ex("/mnt/r/tmp/x", ["tmp"]) and ex("tmp/x", ["tmp"]) and ex("/mnt/r/tmp", ["/mnt/r/tmp"])
    assert not ex("/mnt/r/tmp2", ["tmp"]) and not ex("/mnt/r/a/tmp", ["tmp"]) and not ex("/mnt/r/a", ["", "  "])


def test_parts_of_paths(spark):
    df = spark.createDataFrame([("/a/b.txt",), ("b",), ("/top",), ("x/y/z",)], "p string")
    p = F.col("p")
    got = [tuple(r) for r in df.select(paths.basename(p), paths.dirname(p), paths.ancestors(paths.parts(p)), paths.relative(p, "/a")).collect()]
    assert got == [("b.txt", "/a", ["", "a"], "b.txt"), ("b", ".", [""], "b"), ("top", "/", [""], "top"), ("z", "x/y", ["", "x", "x/y"], "x/y/z")]


def test_depth_first_order(spark):
    names = ["a.txt", "a", "a/x", "a/x/y", "a-b", "b"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = [r.p for r in df.orderBy(paths.parts(F.col("p"))).collect()]
    assert got == ["a", "a/x", "a/x/y", "a-b", "a.txt", "b"]


def test_roots(spark):
    assert paths.common_root(["/a/b/c", "/a/b/d/e"]) == "/a/b" and paths.common_root(["/a", "/b"]) == "/" and paths.common_root(["p/q", "p/r"]) == "p"
    assert paths.disjoint(["/a/b", "/a/bc"]) and not paths.disjoint(["/a", "/a/b"])
    assert paths.clean("/a//b/../c/./") == "/a/c" and paths.clean("a/..") == "."
    got = spark.range(1).select(paths.rebased(F.lit("/tmp/m/x/y"), "/tmp/m", "tank/a"), paths.rebased(F.lit("/tmp/mx"), "/tmp/m", "t")).first()
    assert tuple(got) == ("tank/a/x/y", "/tmp/mx")


def test_sizes_and_globs(spark):
    assert [values.parse_size(x) for x in ("", "10", "10M", "1.5G", "2KB")] == [0, 10, 10 << 20, int(1.5 * (1 << 30)), 2048]
    assert values.format_bytes(1536) == "1.5 KB" and values.format_bytes(12) == "12 B"
    with pytest.raises(ValueError):
        values.parse_size("ten")
    names = ["plan7.csv", "PLAN8.CSV", "notes.md", "oldplan.csv", "a-b", "a]"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    find = lambda g, cs=False: [r.n for r in df.where(values.matches_glob(F.col("n"), g, cs)).collect()]
    assert find("*.csv") == ["plan7.csv", "PLAN8.CSV", "oldplan.csv"] and find("*.csv", True) == ["plan7.csv", "oldplan.csv"]
    assert find("plan?.csv") == ["plan7.csv", "PLAN8.CSV"]
    assert find("*[0-9].csv", True) == ["plan7.csv"] and find("[^p]*", True) == ["PLAN8.CSV", "notes.md", "oldplan.csv", "a-b", "a]"]
    assert find("a\\-b") == ["a-b"] and find("a[\\]\\-]*") == ["a-b", "a]"]
    for bad in ("[a", "[]a]", "[a-]", "[-a]", "a\\"):
        with pytest.raises(ValueError):
            values.glob_to_regex(bad)


def test_words_for_people(spark):
    assert [values.thousands(n) for n in (0, 999, 1000, -1234567)] == ["0", "999", "1,000", "-1,234,567"]
    assert values.plural(1, "file") == "1 file" and values.plural(2000, "directory", "directories") == "2,000 directories"
    assert [values.duration(s) for s in (0, 45, 185, 7205)] == ["0s", "45s", "3m 5s", "2h 0m"]
    assert values.remaining(10, 50, 100) == 10 and values.remaining(0, 0, 100) is None and values.remaining(5, 200, 100) == 0
    df = spark.createDataFrame([("00ff",), ("h1",), ("",), (None,), ("a" * 42,)], "h string")
    got = [None if r[0] is None else bytes(r[0]).hex() for r in df.select(values.hash_bytes(F.col("h"))).collect()]
    import hashlib

    assert got == ["00ff", hashlib.sha1(b"h1").hexdigest(), None, None, hashlib.sha1(b"a" * 42).hexdigest()]


def test_timestamps_and_hashes(spark):
    same = ["2024-03-01T10:00:00.123456Z", "2024-03-01 10:00:00.123456+00:00", "2024-03-01 11:00:00.123456 +0100 CET", "2024-03-01T11:00:00.123456+01:00"]
    df = spark.createDataFrame([(x,) for x in [*same, "junk", None]], "t string")
    got = [r[0] for r in df.select(values.timestamp(F.col("t")).cast("string")).collect()]
    assert got == ["2024-03-01 10:00:00.123456"] * 4 + [None, None]
    df = spark.createDataFrame([("AB",), ("",), ("-",), (None,)], "h string")
    assert [r[0] for r in df.select(values.hash_or_null(F.col("h"))).collect()] == ["ab", None, None, None]
