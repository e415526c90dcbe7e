"""The diff against golden cases and against a plain tree implementation."""
import random

import pytest
import tree_oracle
from pyspark.sql import functions as F

from snaptree import plans
from snaptree.operators import basic, coverage, diff

pytestmark = pytest.mark.usefixtures("quick")

SCHEMA = "path string, size_bytes bigint, sha1 string, md5 string"


def frame(spark, files):
    rows = [(p.lstrip("/"), r[1], r[0], r[0]) if isinstance(r, tuple) else (p, 100, r, r) for p, r in files.items()]
    return spark.createDataFrame(rows, SCHEMA)


def told(spark, a, b, **kw):
    rows = diff.solve(frame(spark, a), frame(spark, b), **kw)[2].orderBy("key").collect()
    return [(r.path, r.status, r.source, *[r[c] for c in diff.COUNTS]) for r in rows]


def brief(spark, a, b, **kw):
    return [(r[1], r[0], r[2]) for r in told(spark, a, b, **kw)]


GOLDEN = {
    "add": ({"c": "h0", "f1": "h1"}, {"c": "h0", "f1": "h1", "f2": "h2"}, [("Added", "f2", None)]),
    "collapse": ({"c": "h0"}, {"c": "h0", "d/1": "h1", "d/2": "h2"}, [("Added", "d/", None)]),
    "directory move": ({"old/1": "h1", "old/2": "h2", "c": "h0"}, {"new/1": "h1", "new/2": "h2", "c": "h0"}, [("Move", "new/", "/old/")]),
    "move beats copy": ({"f1": "h"}, {"f2": "h", "f3": "h"}, [("Move", "f2", "/f1"), ("Copy", "f3", "/f1")]),
    "swap": ({"a": "A", "b": "B"}, {"a": "B", "b": "A"}, [("Move", "a", "/b"), ("Move", "b", "/a")]),
    "no hash": ({"a": None, "c": "h0"}, {"a": None, "c": "h0"}, [("Modified", "a", None)]),
    "file becomes directory": ({"data": "h1", "c": "h0"}, {"data/one": "h2", "data/two": "h3", "c": "h0"}, [("Removed", "data", None), ("Added", "data/one", None), ("Added", "data/two", None)]),
    "source used once": ({"f1": "h", "c": "h0"}, {"f1": "h", "f2": "h", "f3": "h", "c": "h0"}, [("Copy", "f2", "/f1"), ("Added", "f3", None)]),
    "equal": ({"a/b": "h1", "c": "h2"}, {"a/b": "h1", "c": "h2"}, []),
    "removed directory": ({"d/x/1": "h1", "d/2": "h2", "c": "h0"}, {"c": "h0"}, [("Removed", "d/", None)]),
    "one of two changed": ({"d/1": "h1", "d/2": "h2", "c": "h0"}, {"d/1": "h9", "d/2": "h2", "c": "h0"}, [("Modified", "d/1", None)]),
    "all changed": ({"d/1": "h1", "d/2": "h2", "c": "h0"}, {"d/1": "h8", "d/2": "h9", "c": "h0"}, [("Modified", "d/", None)]),
    "only one, changed": ({"d/1": "h1", "c": "h0"}, {"d/1": "h8", "c": "h0"}, [("Modified", "d/1", None)]),
    "file moved into a new directory": ({"f": "h1", "c": "h0"}, {"new/f": "h1", "c": "h0"}, [("Move", "new/f", "/f")]),
    "directory copied": ({"d/1": "h1", "d/2": "h2", "c": "h0"}, {"d/1": "h1", "d/2": "h2", "e/1": "h1", "e/2": "h2", "c": "h0"}, [("Copy", "e/", "/d/")]),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_tree(name):
    a, b, want = GOLDEN[name]
    full = lambda m: {"/" + p: (h, 100) for p, h in m.items()}
    assert [(r[1], r[0], r[2]) for r in tree_oracle.diff(full(a), full(b))] == want


def test_golden(spark):
    """All cases at once, each below a directory of its own that an unchanged file keeps apart; contents are told apart by case."""
    a, b, want = {}, {}, []
    for n, (old, new, lines) in sorted(GOLDEN.items()):
        own = lambda m, n=n: {f"{n}/{p}": h and f"{n}:{h}" for p, h in m.items()}
        a |= own(old) | {f"{n}/~": f"{n}:~"}
        b |= own(new) | {f"{n}/~": f"{n}:~"}
        want += [(s, f"{n}/{p}", src and f"/{n}{src}") for s, p, src in lines]
    assert brief(spark, a, b) == want


def forest(seed: int, trees: int = 60):
    """Random pairs of trees, each below a directory of its own; contents repeat within and across them."""
    r = random.Random(seed)
    a, b = {}, {}

    def add(m, p, h):
        if any(p.startswith(e + "/") or e.startswith(p + "/") for e in m if e.split("/")[0] == p.split("/")[0]):
            return False
        m[p] = (None if r.random() < 0.03 else h, 0 if r.random() < 0.08 else 10)
        return True

    for t in range(trees):
        depth = r.randint(1, 4)
        for _ in range(r.randint(3, 14)):
            p = "/".join([f"t{t:03}", *(r.choice("abcde") for _ in range(r.randint(1, depth)))])
            h = f"h{r.randrange(4)}" + ("" if r.random() < 0.2 else f"-{t}")
            match r.randrange(4):
                case 0:
                    add(a, p, h)
                case 1:
                    add(b, p, h)
                case 2:
                    add(a, p, h) and add(b, p, h) and b.__setitem__(p, a[p])
                case _:
                    add(a, p, h) and add(b, p, h + "x")
    return a, b


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"budget": 1}), (3, {"show_unchanged": True, "budget": 3}), (4, {"moves": False}), (5, {"copies": False}), (6, {"show_unchanged": True})])
def test_forest_equals_tree(spark, seed, options):
    a, b = forest(seed)
    kw = {"show": options.get("show_unchanged", False), **{k: v for k, v in options.items() if k != "show_unchanged"}}
    want = tree_oracle.diff({"/" + k: v for k, v in a.items()}, {"/" + k: v for k, v in b.items()}, **kw)
    got = told(spark, a, b, **options)
    assert sorted(set(want) ^ set(got), key=str) == []
    assert got == want


#: For each kind of change, the statuses of a directory's line that tell of a file below it (fixed values).
TELLS = {
    "removed": ("Removed", "Modified", "Move", "MovedSource", "Truncated"),
    "added": ("Added", "Modified", "Move", "Copy", "Truncated"),
    "modified": ("Modified", "Added", "Removed", "Move", "Copy", "Truncated"),
}


def tells(line_path, status, p, kind):
    """A line at the file's own path tells of it; one of a directory above it does if its status fits the kind of change."""
    at = line_path.strip("/")
    return at not in ("", ".") and (at == p or p.startswith(at + "/") and status in TELLS[kind])


def untold(a, b, rows):
    """Changed files that no line tells of."""
    kinds = {p: "removed" if p not in b else "modified" for p, r in a.items() if p not in b or r[0] is None or b[p][0] != r[0]}
    kinds |= {p: "added" for p in b if p not in a}
    return [
        (p, kind) for p, kind in kinds.items()
        if not any(tells(r[0], r[1], p, kind) or kind == "removed" and r[1] == "Move" and r[2] and tells(r[2], r[1], p, kind) for r in rows)
    ]


def untrue(a, b, rows):
    """Lines of directories that are wholly added or removed, and files of the other side below them that no move names."""
    moved = {r[2].strip("/") for r in rows if r[1] == "Move" and r[2]}
    other = {"Added": a, "Removed": b}
    return [(r[0], p) for r in rows if r[1] in other and r[0].endswith("/") for p in other[r[1]] if p.startswith(r[0]) and p not in moved]


@pytest.mark.parametrize("budget", [0, 1])
def test_plain_tree_tells_every_change(budget):
    for seed in range(150):
        a, b = forest(1000 + seed, trees=6)
        rows = tree_oracle.diff({"/" + k: v for k, v in a.items()}, {"/" + k: v for k, v in b.items()}, budget=budget)
        assert untold(a, b, rows) == [] and untrue(a, b, rows) == [], seed


@pytest.mark.parametrize("seed, budget", [(7, 0), (8, 1)])
def test_every_change_is_told(spark, seed, budget):
    a, b = forest(seed)
    rows = told(spark, a, b, budget=budget)
    assert untold(a, b, rows) == [] and untrue(a, b, rows) == []


def test_finished_and_update_mode(spark):
    a, b = frame(spark, {"x/1": "h1", "x/2": "h2", "c": "h0"}), frame(spark, {"y/1": "h1", "y/2": "h2", "c": "h9"})
    got = diff.diff(a, b, "/A", "/B/").orderBy("line_no").collect()
    assert [(r.line_no, r.path, r.root, r.rel_path, r.status, r.source_path) for r in got] == [(1, "/A/c", "/A", "c", "Modified", None), (2, "/B/y/", "/B", "y/", "Move", "/A/x/")]
    assert [r.rel_path for r in diff.update_mode(diff.diff(a, b)).collect()] == ["c"]


def test_sources_that_clash_are_refused(spark):
    a = spark.createDataFrame([("/r/x", 1, "h1", None)], SCHEMA)
    b = spark.createDataFrame([("/s/x", 1, "h2", None)], SCHEMA)
    with pytest.raises(Exception, match="two sources hold the path x"):
        basic.combined([(a, "/r"), (b, "/s")]).collect()
    assert basic.combined([(a, "/r"), (b, "/t")]).count() == 2


def test_empty_sides(spark):
    assert brief(spark, {"a": "h"}, {"b": "i"}) == [("Removed", "a", None), ("Added", "b", None)]
    none = spark.createDataFrame([], SCHEMA)
    assert diff.solve(none, none)[2].collect() == []
    assert [r.status for r in diff.solve(frame(spark, {"d/a": "h"}), none)[2].collect()] == ["Removed"]


def test_levels_by_shuffles_and_in_one_task_agree(spark):
    """The roll-up gives the same whether a few or no directories are left to one task."""
    a, b = forest(11)
    files = diff.saved(diff.with_twins(diff.pair(frame(spark, a), frame(spark, b))).withColumn("source", F.when(F.col("path").like("%a"), F.lit("/s"))))
    files = files.withColumn("status", F.when((F.col("status") == "Added") & F.col("path").rlike("[ab]$"), F.when(F.col("path").like("%a"), "Move").otherwise("Copy")).when((F.col("status") == "Removed") & F.col("path").like("%c"), "MovedSource").otherwise(F.col("status")))
    dirs = diff.saved(diff.directories(files))
    some = dirs.where("path like '%/b'").select("path", F.lit("Move").alias("status"), F.lit("/x/").alias("source"))
    got = [sorted(map(tuple, diff.rolled(files, dirs, some, few).collect()), key=str) for few in (0, 70, 100_000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == dirs.count() and {r[1] for r in got[0]} >= {"Mixed", "Move", "Added", "Removed", "Modified", "Unchanged"}


def test_plans(spark):
    """Sides are paired by one equi-join, only the columns asked for are read, and no row is paired with all others."""
    rows = [(f"d{i % 9}/f{i}", i, f"h{i}", None, "x" * 50) for i in range(200)]
    wide = diff.saved(spark.createDataFrame(rows, SCHEMA + ", note string"))
    pairs = diff.pair(wide, wide)
    assert plans.joins(pairs) == ["SortMergeJoin"] or len(plans.joins(pairs)) == 1
    assert not plans.pairs_all(pairs) and not plans.runs_python(pairs)
    assert all("note" not in c and "md5" not in c for c in plans.read_columns(pairs))
    found = basic.find(wide.where("size_bytes >= 100"), "f1*").select("path")
    assert plans.exchanges(found) == 0 and any("size_bytes" in p for p in plans.pushed(found))
    tags = coverage.tagged(wide, [wide])
    assert not plans.pairs_all(tags) and not plans.runs_python(tags)
