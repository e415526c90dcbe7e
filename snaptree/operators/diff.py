"""Difference of two snapshots, with moves, copies and directory roll-up.

A file without a hash on either side is never unchanged, and a summary line never hides a loss: a
move's source that no line mentions is reported as removed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..tables import cleaned, saved
from .rank import ranked
from .tree import below, digest, entry_words

CHANGES = ("Added", "Removed", "Modified", "Move", "Copy")
#: Rounds of the search for sources that no line mentions, at most.
ROUNDS = 32
#: Directories that one task rolls up.
FEW = 100_000


def pair(a: DataFrame, b: DataFrame, hash_type: str = "sha1") -> DataFrame:
    """path, p, in_a, in_b, ha, hb, sa, sb, status of each file of two sides with relative paths."""
    one = lambda df, s: df.select(paths.joined(paths.parts(F.col("path"))).alias("path"), F.lit(True).alias(f"in_{s}"), F.col(hash_type).alias(f"h{s}"), F.col("size_bytes").alias(f"s{s}"))
    j = one(a, "a").join(one(b, "b"), "path", "full_outer")
    j = j.withColumns({"in_a": F.coalesce("in_a", F.lit(False)), "in_b": F.coalesce("in_b", F.lit(False))})
    same = F.coalesce(F.col("ha") == F.col("hb"), F.lit(False))
    status = F.when(~F.col("in_b"), "Removed").when(~F.col("in_a"), "Added").when(same, "Unchanged").otherwise("Modified")
    return j.select("path", F.split("path", "/").alias("p"), "in_a", "in_b", "ha", "hb", "sa", "sb", status.alias("status"))


def with_twins(pairs: DataFrame) -> DataFrame:
    """pairs with is_twin: the path is a directory on the other side."""
    parents = pairs.select(F.slice("p", 1, F.size("p") - 1).alias("p")).distinct()
    dirs = parents.select(F.explode(paths.ancestors(F.col("p"), True)).alias("path")).distinct().withColumn("is_twin", F.lit(True))
    return pairs.join(dirs, "path", "left").withColumn("is_twin", F.coalesce("is_twin", F.lit(False)))


def directories(files: DataFrame) -> DataFrame:
    """path, in_a, in_b, ka, kb, n_a, n_b of each directory: presence, digests and number of files by side."""
    up = files.select("path", "is_twin", "in_a", "in_b", "ha", "hb", F.explode(paths.ancestors(F.col("p"))).alias("up"))
    cols = []
    for s in "ab":
        words = entry_words(below(F.col("path"), F.col("up")), F.col("is_twin").cast("string"), F.col(f"h{s}"))
        cols += [F.when(F.col(f"h{s}").isNotNull(), w).alias(f"{s}{i}") for i, w in enumerate(words)]
    rows = up.select("up", "in_a", "in_b", *cols)
    return rows.groupBy("up").agg(
        F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b"), F.concat(F.lit("d:"), digest("a")).alias("ka"), F.concat(F.lit("d:"), digest("b")).alias("kb"),
        F.count_if("in_a").alias("n_a"), F.count_if("in_b").alias("n_b"),
    ).withColumnRenamed("up", "path")


def _place(path: Column) -> dict[str, Column]:
    p = F.split(path, "/")
    n = F.when(path == "", 0).otherwise(F.size(p))
    return {"depth": n, "parent": F.array_join(F.slice(p, 1, F.greatest(n - 1, F.lit(0))), "/"), "name": F.element_at(p, -1)}


_FLAGS = {
    "all_unch": ("Unchanged",), "all_ms": ("MovedSource",), "all_rm": ("Removed", "MovedSource"), "all_add": ("Added", "Copy", "Move", "MovedSource"),
}
_KINDS = {"move": "Move", "copy": "Copy", "add": "Added", "mod": "Modified", "ms": "MovedSource"}


def _facts() -> list[Column]:
    """What a directory has to know of one child (name, status, source, has_unch); facts of several are put together by _together()."""
    s = F.col("status")
    first = lambda of: F.when((s == of) & F.col("source").isNotNull(), F.struct(F.col("name"), F.col("source")))
    return [
        *[s.isin(*of).alias(k) for k, of in _FLAGS.items()], *[(s == of).alias(k) for k, of in _KINDS.items()],
        F.col("has_unch").alias("unch"), s.isin(*CHANGES).cast("bigint").alias("n"), first("Move").alias("move_src"), first("Copy").alias("copy_src"),
    ]


def _together() -> list[Column]:
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(True)).alias(c)
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    return [*map(every, _FLAGS), *map(some, [*_KINDS, "unch"]), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("move_src").alias("move_src"), F.min("copy_src").alias("copy_src")]


_FACTS = [*_FLAGS, *_KINDS, "unch", "n", "move_src", "copy_src"]
_OWN = ["in_a", "m_status", "m_source", "twin"]


def _decided() -> list[Column]:
    """status, has_unch, source of a directory from the facts of all its children and its own."""
    c = F.col
    r = lambda status, has, source=None: F.struct(F.lit(status).alias("status"), has.alias("has_unch"), (source if source is not None else F.lit(None).cast("string")).alias("source"))
    no, yes = F.lit(False), F.lit(True)
    can = ~c("unch") & (c("all_add") | (c("n") >= 2))
    plain = can & c("all_add") & ~c("ms")
    kinds = c("move").cast("int") + c("copy").cast("int") + c("add").cast("int")
    out = (
        F.when(c("m_status").isNotNull(), F.struct(c("m_status").alias("status"), no.alias("has_unch"), c("m_source").alias("source")))
        .when(c("all_unch"), r("Unchanged", yes))
        .when(c("all_ms"), r("MovedSource", no))
        .when(c("all_rm"), r("Removed", no))
        .when(~c("in_a") & c("all_add") & ((~c("move") & ~c("copy")) | (c("n") > 1)), r("Added", no))
        .when(can & c("mod"), r("Modified", c("unch")))
        .when(plain & (kinds > 1), r("Modified", c("unch")))
        .when(plain & c("move") & (c("n") == 1), r("Mixed", c("unch")))
        .when(plain & c("move"), r("Move", no, c("move_src.source")))
        .when(plain & c("add"), r("Added", no))
        .when(plain & c("copy") & (c("n") == 1), r("Mixed", c("unch")))
        .when(plain & c("copy"), r("Copy", no, c("copy_src.source")))
        .when(can & ~c("in_a"), r("Added", no))
        .when(can, r("Modified", no))
        .otherwise(r("Mixed", c("unch")))
    )
    status = F.when(c("twin").isNull() | (c("twin") == "Unchanged") | (c("twin") == out["status"]), out["status"]).otherwise("Mixed")
    return [status.alias("status"), (out["has_unch"] | F.coalesce(c("twin") == "Unchanged", no)).alias("has_unch"), out["source"].alias("source")]


def rolled(files: DataFrame, dirs: DataFrame, matched: DataFrame | None = None, few: int = FEW) -> DataFrame:
    """path, status, has_unch, source of each directory, from the deepest level up.

    files: path, is_twin, status, source.  dirs: path, in_a.  matched: path, status, source of directories whose content was matched.
    Files are put together by directory once.  Levels are rolled up by a shuffle each while more than `few` directories are
    left; the rest, where a level is no work, goes through one task without a shuffle or a write.
    """
    f = files.where("not is_twin").select("path", "status", "source", (F.col("status") == "Unchanged").alias("has_unch")).withColumns(_place(F.col("path")))
    leaf = f.select(F.col("parent").alias("path"), *_facts()).groupBy("path").agg(*_together())
    twin = files.where("is_twin").select("path", F.col("status").alias("twin"))
    nodes = dirs.select("path", "in_a").join(leaf, "path", "left").join(twin, "path", "left")
    if matched is not None:
        nodes = nodes.join(matched.select("path", F.col("status").alias("m_status"), F.col("source").alias("m_source")), "path", "left")
    else:
        nodes = nodes.withColumns({"m_status": F.lit(None).cast("string"), "m_source": F.lit(None).cast("string")})
    nodes = saved(nodes.withColumns(_place(F.col("path"))).drop("name"), "depth")
    sizes = dict(nodes.groupBy("depth").count().collect())  # a row for each level
    parent_facts = lambda level: level.withColumns(_place(F.col("path"))).select(F.col("parent").alias("path"), *_facts())
    empty = lambda cols: [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in cols]

    def own(k: int) -> DataFrame:
        return nodes.where(F.col("depth") == k).select("path", *_FACTS, *_OWN)

    def level_of(rows: DataFrame, more=()) -> DataFrame:
        only = [F.max(c).alias(c) for c in _OWN]
        return rows.groupBy("path").agg(*_together(), *only, *more)

    k, level, done = max(sizes, default=-1), None, []
    while k >= 0 and sum(n for at, n in sizes.items() if at <= k) > few:
        rows = own(k)
        if level is not None:
            rows = rows.unionByName(parent_facts(level).select("*", *empty(_OWN)))
        level = saved(level_of(rows).select("path", *_decided()))
        done.append(level)
        k -= 1
    if k >= 0:
        # one task: each level hands up what is decided below it
        kind = "array<struct<path:string,status:string,has_unch:boolean,source:string>>"
        nothing = F.array().cast(kind).alias("below")
        last = None if level is None else parent_facts(level).groupBy("path").agg(*_together()).select("*", *empty(_OWN), nothing)
        for at in range(k, -1, -1):
            rows = own(at).select("*", nothing)
            rows = rows if last is None else rows.unionByName(last)
            found = level_of(rows.coalesce(1), [F.flatten(F.collect_list("below")).alias("below")]).select("path", *_decided(), "below")
            up = F.concat(F.col("below"), F.array(F.struct("path", "status", "has_unch", "source")))
            last = found.withColumn("below", up).withColumns(_place(F.col("path"))).select(F.col("parent").alias("path"), *_facts(), *empty(_OWN), "below")
        done.append(saved(last.select(F.explode("below").alias("r")).select("r.*")))
    if not done:
        return nodes.select("path", F.lit("").alias("status"), F.lit(False).alias("has_unch"), F.col("m_source").alias("source"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def match(files: DataFrame, dirs: DataFrame, moves: bool = True, copies: bool = True) -> DataFrame:
    """path, is_twin, is_dir, status (Move or Copy), source, source_path, source_is_twin, marks of each matched target.

    files and dirs carry the statuses of the first roll-up.  Each source is used once in each of its roles:
    removed, modified, and any source.  marks: the source is spent as a removal.
    """
    key = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("f:"), F.col(c)))
    n = files.select("path", "is_twin", F.lit(False).alias("is_dir"), "status", "in_a", "in_b", F.when(F.col("sa") != 0, key("ha")).alias("ka"), F.when(F.col("sb") != 0, key("hb")).alias("kb"))
    n = n.unionByName(dirs.select("path", F.lit(False).alias("is_twin"), F.lit(True).alias("is_dir"), "status", "in_a", "in_b", "ka", "kb"))
    n = n.withColumn("ord", F.split("path", "/"))
    src = n.where(F.col("in_a") & (F.col("status") != "Added") & F.col("ka").isNotNull()).withColumnRenamed("ka", "key")
    tgt = n.where(F.col("in_b") & F.col("status").isin("Added", "Modified") & F.col("kb").isNotNull() & ~(F.col("is_dir") & F.col("in_a"))).withColumnRenamed("kb", "key")
    # only contents that both sides have are ranked
    keys = saved(src.select("key").distinct().join(tgt.select("key").distinct(), "key", "left_semi"))
    cols = ["key", "path", "is_twin", "is_dir", "status", "ord"]
    src, tgt = src.join(keys, "key").select(*cols), tgt.join(keys, "key").select(*cols)
    roles = []
    for role, own in (("R", src.where("status = 'Removed'")), ("M", src.where("status = 'Modified'")), ("E", src)):
        roles.append(own.withColumn("role", F.lit(role)))
    pool = ranked(roles[0].unionByName(roles[1]).unionByName(roles[2]), ["key", "role"], ["ord", "is_twin", "is_dir"])
    pool = saved(pool.select("key", "role", F.col("rank").alias("at"), F.col("path").alias("source_path"), F.col("is_twin").alias("source_is_twin"), F.col("is_dir").alias("source_is_dir")))
    of = lambda r: F.count_if(F.col("role") == r).alias(f"n_{r}")
    sizes = saved(pool.groupBy("key").agg(of("R"), of("M"), of("E")))
    t = ranked(tgt, ["key"], ["ord", "is_twin"]).join(sizes, "key")
    from_r = F.col("rank") <= F.col("n_R") if moves else F.lit(False)
    j = F.col("rank") - (F.col("n_R") if moves else F.lit(0))
    taken = t.where(from_r).withColumns({"role": F.lit("R"), "at": F.col("rank"), "status": F.lit("Move")})
    rest = t.where(~from_r)
    if copies:
        role = F.when(j <= F.col("n_M"), "M").when(j - F.col("n_M") <= F.col("n_E"), "E")
        status = F.when((j <= F.col("n_M")) & (F.col("status") == "Modified") & F.lit(moves), "Move").otherwise("Copy")
        more = rest.withColumns({"role": role, "at": F.when(j <= F.col("n_M"), j).otherwise(j - F.col("n_M")), "status": status}).where("role is not null")
    else:
        again = ranked(rest.where("status = 'Modified'").drop("rank"), ["key"], ["ord", "is_twin"])
        more = again.where(F.col("rank") <= F.col("n_M")).withColumns({"role": F.lit("M"), "at": F.col("rank"), "status": F.lit("Move")})
        more = more if moves else more.where("false")
    found = taken.unionByName(more).join(pool, ["key", "role", "at"])
    source = F.concat(F.lit("/"), F.col("source_path"), F.when(F.col("source_is_dir") & (F.col("source_path") != ""), F.lit("/")).otherwise(F.lit("")))
    return found.select("path", "is_twin", "is_dir", "status", source.alias("source"), "source_path", "source_is_twin", "source_is_dir", (F.col("role") == "R").alias("marks"))


def _counts(files: DataFrame, dirs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Counts of file statuses, and of unchanged directories, below each wanted path: by directory first, then up its ancestors."""
    names = {"Added": "added_count", "Removed": "removed_count", "Modified": "modified_count", "Copy": "copy_count", "Move": "move_count", "Unchanged": "unchanged_file_count", "dir": "unchanged_dir_count"}
    # a twin counts for the directory of its own path
    at = F.when(F.col("is_twin"), F.col("path")).otherwise(_place(F.col("path"))["parent"])
    rows = files.select(at.alias("path"), "status").unionByName(dirs.where("status = 'Unchanged'").select("path", F.lit("dir").alias("status")))
    own = rows.groupBy("path").agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in names.items()])
    up = F.when(F.col("path") == "", F.array(F.lit(""))).otherwise(paths.ancestors(F.split("path", "/"), True))
    above = own.select(F.explode(up).alias("path"), *names.values()).groupBy("path").agg(*[F.sum(n).alias(n) for n in names.values()])
    return above.join(wanted.select("path").distinct(), "path", "left_semi")


COUNTS = ("added_count", "removed_count", "modified_count", "copy_count", "move_count", "unchanged_file_count", "unchanged_dir_count", "hidden_count")


def _step(kind: int, name: Column, turn: Column) -> Column:
    return F.struct(F.lit(kind).alias("k"), name.alias("n"), turn.alias("t"))


def lines(files: DataFrame, dirs: DataFrame, show_unchanged: bool = False, budget: int = 0) -> DataFrame:
    """path (a directory's ends in a slash; `.`: the root), status, source, counts and key (the order) of each line."""
    plain = F.lit(0)
    nodes = files.select("path", "is_twin", F.lit(False).alias("is_dir"), "status", "source")
    nodes = nodes.unionByName(dirs.where("path <> ''").select("path", F.lit(False).alias("is_twin"), F.lit(True).alias("is_dir"), "status", "source"))
    nodes = nodes.withColumn("p", F.split("path", "/"))
    blocked = dirs.where("path <> '' and status <> 'Mixed'").select(F.col("path").alias("up"))
    told = nodes.where(F.col("status").isin(*CHANGES) | (F.col("is_dir") & (F.col("status") == "Mixed")))
    # what lies in a hidden directory is found by its parent alone
    shut = dirs.where("path <> ''").select(F.col("path").alias("parent"), F.explode(paths.ancestors(F.split("path", "/"), True)).alias("up")).join(blocked, "up", "left_semi").select("parent").distinct()
    told = saved(told.withColumn("parent", _place(F.col("path"))["parent"]).join(shut, "parent", "left_anti").drop("parent"))
    base = told.where("status <> 'Mixed'")
    wanted = told.where("is_dir").select("path").unionByName(told.sparkSession.createDataFrame([("",)], "path string"))
    counted = saved(_counts(files, dirs, wanted))
    one = {c: F.when(F.col("is_dir"), F.coalesce(c, F.lit(0))).otherwise(F.when(F.col("status") == s, 1).otherwise(0)).cast("bigint") for c, s in zip(COUNTS[:5], ("Added", "Removed", "Modified", "Copy", "Move"), strict=True)}
    shown = lambda c: (F.coalesce(c, F.lit(0)) if show_unchanged else F.lit(0)).cast("bigint")
    turn = F.when(~F.col("is_twin"), 0).when(F.col("status") == "Removed", -1).otherwise(1)
    steps = F.transform("p", lambda x, i: _step(0, x, F.when(i == F.size("p") - 1, turn).otherwise(plain)))
    out = base.join(counted, "path", "left").select(
        F.concat("path", F.when(F.col("is_dir"), "/").otherwise("")).alias("path"), "status", "source", *[one[c].alias(c) for c in COUNTS[:5]],
        *[F.when(F.col("is_dir"), shown(c)).otherwise(0).cast("bigint").alias(c) for c in COUNTS[5:7]], F.lit(0).cast("bigint").alias("hidden_count"),
        steps.alias("key"), F.slice("p", 1, F.size("p") - 1).alias("owner"),
    )
    if show_unchanged:
        mixed = told.where("status = 'Mixed'").select("path", "p", "source").unionByName(told.sparkSession.createDataFrame([("", [], None)], "path string, p array<string>, source string"))
        context = mixed.join(counted, "path").where("unchanged_file_count + unchanged_dir_count > 0")
        zero = F.lit(0).cast("bigint")
        out = out.unionByName(context.select(
            F.when(F.col("path") == "", ".").otherwise(F.concat("path", F.lit("/"))).alias("path"), F.lit("Mixed").alias("status"), "source", *[zero.alias(c) for c in COUNTS[:5]], "unchanged_file_count", "unchanged_dir_count", zero.alias("hidden_count"),
            F.concat(F.transform("p", lambda x: _step(0, x, plain)), F.array(_step(2, F.lit(""), plain))).alias("key"), F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))).alias("owner"),
        ))
    return _budgeted(out, budget) if budget > 0 else out


def _budgeted(out: DataFrame, budget: int) -> DataFrame:
    """The first `budget` lines below each directory and one Truncated line for the others, from the deepest level up."""
    out = saved(out)
    depth = out.agg(F.max(F.size("owner"))).first()[0] or 0
    for k in range(depth, 0, -1):
        inside = out.where(F.size("owner") >= k).withColumns({"dir": F.slice("owner", 1, k), "part": F.spark_partition_id()})
        # what is not among the first of its part is not among the first of all, so no task gets a whole directory
        parted = inside.withColumn("n", F.row_number().over(Window.partitionBy("part", "dir").orderBy("key"))).drop("part")
        first = parted.where(F.col("n") <= budget).withColumn("n", F.row_number().over(Window.partitionBy("dir").orderBy("key")))
        rows = parted.where(F.col("n") > budget).unionByName(first)
        over = rows.where(F.col("n") > budget).groupBy("dir").agg(*[F.sum(c).alias(c) for c in COUNTS[:7]], (F.sum("hidden_count") + F.count("*")).alias("hidden_count"))
        cut = over.select(
            F.concat(F.array_join("dir", "/"), F.lit("/")).alias("path"), F.lit("Truncated").alias("status"), F.lit(None).cast("string").alias("source"), *COUNTS,
            F.concat(F.transform("dir", lambda x: _step(0, x, F.lit(0))), F.array(_step(1, F.lit(""), F.lit(0)))).alias("key"), F.slice("dir", 1, k - 1).alias("owner"),
        )
        kept = rows.where(F.col("n") <= budget).drop("n", "dir")
        out = saved(out.where(F.size("owner") < k).unionByName(kept).unionByName(cut))
    return out


def _unmentioned(files: DataFrame, dirs: DataFrame, told: DataFrame) -> DataFrame:
    """path, is_twin of the files that were spent as a move's source, but whose highest such node no line mentions."""
    trim = lambda c: F.regexp_replace(F.regexp_replace(c, "^/", ""), "/$", "")
    named = told.where("status = 'Move' and source is not null").select(trim(F.col("source")).alias("up"))
    named = named.unionByName(told.where("status in ('Removed', 'Modified')").select(trim(F.col("path")).alias("up"))).where("up <> ''").distinct()
    spent = files.where("status = 'MovedSource'").select("path", "is_twin")
    chain = spent.select("path", "is_twin", F.explode(paths.ancestors(F.split("path", "/"), True)).alias("up"))
    ms = dirs.where("status = 'MovedSource'").select(F.col("path").alias("up"))
    highest = chain.join(ms, "up").groupBy("path", "is_twin").agg(F.min_by("up", F.length("up")).alias("top"))
    spent = saved(spent.join(highest, ["path", "is_twin"], "left").withColumn("top", F.coalesce("top", "path")))
    safe = spent.select("path", "is_twin", F.explode(paths.ancestors(F.split("top", "/"), True)).alias("up")).where("up <> ''").join(named, "up", "left_semi").select("path", "is_twin").distinct()
    return spent.join(safe, ["path", "is_twin"], "left_anti").select("path", "is_twin")


def solve(a: DataFrame, b: DataFrame, hash_type: str = "sha1", moves: bool = True, copies: bool = True, show_unchanged: bool = False, budget: int = 0):
    """(files, dirs, lines) of two sides with relative paths, with their final statuses."""
    files = saved(with_twins(pair(a, b, hash_type)).withColumn("source", F.lit(None).cast("string")))
    dirs = saved(directories(files))
    facts = dirs.select("path", "in_a", "in_b", "ka", "kb")
    status = rolled(files, dirs)
    matched = None
    if moves or copies:
        found = saved(match(files, facts.join(status.select("path", "status"), "path"), moves, copies))
        hit = found.where("not is_dir").select("path", "is_twin", F.col("status").alias("m_status"), F.col("source").alias("m_source"))
        spent = found.where("marks and not source_is_dir").select(F.col("source_path").alias("path"), F.col("source_is_twin").alias("is_twin"), F.lit(True).alias("spent")).distinct()
        files = files.join(hit, ["path", "is_twin"], "left").join(spent, ["path", "is_twin"], "left")
        now = F.when(F.col("m_status").isNotNull(), F.col("m_status")).when(F.col("spent"), "MovedSource").otherwise(F.col("status"))
        files = saved(files.withColumns({"status": now, "source": F.col("m_source")}).drop("m_status", "m_source", "spent"))
        matched = saved(found.where("is_dir").select("path", "status", "source"))
        frozen = status
        status = _refrozen(rolled(files, dirs, matched), frozen, matched)
    told = saved(lines(files, status, show_unchanged, budget))
    for turn in range(ROUNDS + 1 if matched is not None else 0):
        lost = saved(_unmentioned(files, status, told))
        if lost.isEmpty():
            break
        if turn == ROUNDS:
            raise RuntimeError(f"sources of moves are still not mentioned after {ROUNDS} rounds")
        files = saved(files.join(lost.withColumn("lost", F.lit(True)), ["path", "is_twin"], "left").withColumn("status", F.when(F.col("lost"), "Removed").otherwise(F.col("status"))).drop("lost"))
        status = _refrozen(rolled(files, dirs, matched), frozen, matched)
        told = saved(lines(files, status, show_unchanged, budget))
    return files, status, told


def _refrozen(now: DataFrame, before: DataFrame, matched: DataFrame) -> DataFrame:
    """now, but with the earlier status of the directories below a matched one."""
    inner = before.where("path <> ''").select("path", F.explode(paths.ancestors(F.split("path", "/"))).alias("up")).join(matched.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct()
    old = before.join(inner, "path", "left_semi").select("path", F.col("status").alias("o_status"))
    out = now.join(old, "path", "left")
    # a source that was spent or given back below a matched directory is told by the new status
    keep = F.col("o_status").isNotNull() & ~F.col("status").isin("MovedSource", "Removed")
    return saved(out.withColumn("status", F.when(keep, F.col("o_status")).otherwise(F.col("status"))).drop("o_status"))


def finished(told: DataFrame, root_a: str, root_b: str, number: bool = True) -> DataFrame:
    """Lines with absolute paths: what is removed or modified is named as in A, all else as in B; sources are in A."""
    a, b = root_a.rstrip("/"), root_b.rstrip("/")
    root = F.when(F.col("status").isin("Removed", "Modified"), F.lit(a)).otherwise(F.lit(b))
    rel = F.when(F.col("path") == ".", F.lit(".")).otherwise(F.col("path"))
    full = F.when(F.col("path") == ".", root).otherwise(F.concat(root, F.lit("/"), F.col("path")))
    source = F.regexp_replace("source", "^/", "")
    cols = [
        full.alias("path"), root.alias("root"), rel.alias("rel_path"), F.col("status"), F.when(F.col("source").isNotNull(), F.concat(F.lit(a + "/"), source)).alias("source_path"),
        F.when(F.col("source").isNotNull(), F.lit(a)).alias("source_root"), source.alias("source_rel_path"), *COUNTS,
    ]
    if not number:
        return told.select(*cols)
    return ranked(told.withColumn("all", F.lit(0)), ["all"], ["key"], "line_no").select(*cols, "line_no")


@cleaned
def diff(a: DataFrame, b: DataFrame, root_a: str = "", root_b: str = "", hash_type: str = "sha1", moves: bool = True, copies: bool = True, show_unchanged: bool = False, budget: int = 0) -> DataFrame:
    """The lines of a diff of two sides whose paths are relative to their roots, with line_no."""
    return finished(solve(a, b, hash_type, moves, copies, show_unchanged, budget)[2], root_a, root_b)


def update_mode(result: DataFrame) -> DataFrame:
    """What an update would lose: lines of what is removed, modified or truncated, and context lines."""
    return result.where(F.col("status").isin("Removed", "Modified", "Truncated", "Mixed"))
