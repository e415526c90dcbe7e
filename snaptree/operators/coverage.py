"""Coverage: is the content of each file of one snapshot still in others?

Files without a hash are never covered.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..tables import cleaned, saved


def tagged(candidate: DataFrame, keepers: list[DataFrame], hash_type: str = "sha1", min_size: int = 0, excludes=(), root: str = "") -> DataFrame:
    """path, size_bytes and status (covered, uncovered or no_hash) of the candidate's files of at least min_size."""
    c = candidate.where(F.col("size_bytes") >= min_size)
    if excludes:
        c = c.where(~paths.excluded(F.col("path"), root, excludes))
    c = c.select("path", "size_bytes", F.col(hash_type).alias("h"))
    held = None
    for k in keepers:
        x = k.select(F.col(hash_type).alias("h")).where("h is not null")
        held = x if held is None else held.union(x)
    if held is None:
        held = candidate.select(F.col(hash_type).alias("h")).where("false")
    # one row for each hash, so a content that many files share is not multiplied
    found = c.where("h is not null").join(held.distinct().withColumn("held", F.lit(True)), "h", "left")
    status = F.when(F.col("held"), "covered").otherwise("uncovered")
    # files without a hash join with nothing, so they are not sent to the one task that a null key makes
    none = c.where("h is null").select("path", "size_bytes", F.lit("no_hash").alias("status"))
    return found.select("path", "size_bytes", status.alias("status")).unionByName(none)


def summary(tags: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    b = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("size_bytes"))), F.lit(0)).cast("bigint").alias(f"bytes_{s}")
    kinds = ("covered", "uncovered", "no_hash")
    return tags.agg(F.count("*").alias("n_files"), *[n(s) for s in kinds], *[b(s) for s in kinds])


def uncovered(tags: DataFrame) -> DataFrame:
    return tags.where("status <> 'covered'")


def by_dir(tags: DataFrame) -> DataFrame:
    """dir, n_files and n_bytes of what is not covered."""
    return uncovered(tags).groupBy(paths.dirname(F.col("path")).alias("dir")).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("n_bytes"))


def _summed(tags: DataFrame) -> DataFrame:
    """dir, n_covered, n_uncovered, n_no_hash, n_bytes of all files below each directory: by directory first, then up its ancestors."""
    p = paths.parts(F.col("path"))
    own = tags.select(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))).alias("p"), "status", "size_bytes")
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    own = own.groupBy("p").agg(n("covered"), n("uncovered"), n("no_hash"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("n_bytes"))
    cols = ("n_covered", "n_uncovered", "n_no_hash", "n_bytes")
    return own.select(F.explode(paths.ancestors(F.col("p"), True)).alias("dir"), *cols).groupBy("dir").agg(*[F.sum(c).cast("bigint").alias(c) for c in cols])


def rollup(tags: DataFrame) -> DataFrame:
    """dir, depth, n_covered, n_uncovered, n_no_hash and verdict of each directory, with all below it (``: the root)."""
    out = _summed(tags).drop("n_bytes")
    bad = F.col("n_uncovered") + F.col("n_no_hash")
    verdict = F.when(bad == 0, "covered").when(F.col("n_covered") == 0, "not_covered").otherwise("mixed")
    return out.select("dir", F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/"))).cast("bigint").alias("depth"), "n_covered", "n_uncovered", "n_no_hash", verdict.alias("verdict"))


@cleaned
def rollup_lines(tags: DataFrame, detail: int = 3) -> DataFrame:
    """path, kind and n_bad of the lines of a rolled-up report.

    A directory gets a line if all above it are mixed with more than `detail` bad files; a mixed one with
    fewer also shows its bad files.
    """
    tags = saved(tags)
    dirs = saved(rollup(tags).withColumn("n_bad", F.col("n_uncovered") + F.col("n_no_hash")))
    opened = dirs.where((F.col("verdict") == "mixed") & (F.col("n_bad") > detail)).select(F.col("dir").alias("up"))
    closed = dirs.where((F.col("verdict") != "mixed") | (F.col("n_bad") <= detail)).select(F.col("dir").alias("up"))
    above = dirs.select("dir", F.explode(paths.ancestors(F.split("dir", "/"))).alias("up")).where("dir <> ''")
    hidden = above.join(closed, "up", "left_semi").select("dir").distinct()
    shown = dirs.join(hidden, "dir", "left_anti")
    kind = F.when(F.col("verdict") != "mixed", F.col("verdict")).when(F.col("n_bad") <= detail, "listed").otherwise("summary")
    lines = shown.select(F.col("dir").alias("path"), kind.alias("kind"), "n_bad")
    files = uncovered(tags).select(paths.joined(paths.parts(F.col("path"))).alias("path"), "status").withColumn("up", paths.parent(F.col("path")))
    # the directories at and below the listed ones
    listed = lines.where("kind = 'listed'").select(F.col("path").alias("up"))
    below = dirs.select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(paths.ancestors(F.split("dir", "/"), True))).alias("up")).join(listed, "up", "left_semi").select(F.col("dir").alias("up"))
    inside = files.join(below, "up").select("path", F.col("status").alias("kind"), F.lit(1).cast("bigint").alias("n_bad"))
    # files right in a summarised directory
    own = files.join(opened, "up", "left_semi").join(hidden.select(F.col("dir").alias("up")), "up", "left_anti")
    return lines.unionByName(inside).unionByName(own.select("path", F.col("status").alias("kind"), F.lit(1).cast("bigint").alias("n_bad")))


@cleaned
def report(tags: DataFrame, detail: int = 3) -> DataFrame:
    """path, depth, kind, n_covered, n_uncovered, n_no_hash, n_bytes, n_dirs of the lines of a roll-up for people.

    As rollup_lines(), but each file that is listed has its size, and the wholly covered directories right in a
    summarised one are folded into one line of kind `folded` with their number (n_dirs) and their files.
    """
    tags = saved(tags)
    lines = saved(rollup_lines(tags, detail))
    own = lines.where("kind in ('covered', 'not_covered', 'listed', 'summary')").select("path", "kind")
    dirs = _summed(tags).withColumnRenamed("dir", "path").join(own, "path")
    dirs = saved(dirs.withColumn("parent", F.when(F.col("path") != "", paths.parent(F.col("path")))))
    opened = dirs.where("kind = 'summary'").select(F.col("path").alias("parent"))
    fold = dirs.where("kind = 'covered'").join(opened, "parent", "left_semi")
    zero = F.lit(0).cast("bigint")
    cols = ["path", "kind", "n_covered", "n_uncovered", "n_no_hash", "n_bytes", "n_dirs"]
    shown = dirs.join(fold.select("path"), "path", "left_anti").withColumn("n_dirs", zero).select(*cols)
    folded = fold.groupBy(F.col("parent").alias("path")).agg(F.sum("n_covered").alias("n_covered"), F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_dirs"))
    folded = folded.withColumns({"kind": F.lit("folded"), "n_uncovered": zero, "n_no_hash": zero}).select(*cols)
    one = lines.where("kind in ('uncovered', 'no_hash')").select("path", "kind").distinct()
    files = tags.select(paths.joined(paths.parts(F.col("path"))).alias("path"), "size_bytes").join(one, "path")
    files = files.select("path", "kind", zero.alias("n_covered"), (F.col("kind") == "uncovered").cast("bigint").alias("n_uncovered"), (F.col("kind") == "no_hash").cast("bigint").alias("n_no_hash"), F.col("size_bytes").alias("n_bytes"), zero.alias("n_dirs"))
    out = shown.unionByName(folded).unionByName(files)
    return out.withColumn("depth", F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/"))).cast("bigint"))


def negotiate(candidate: dict, keepers: list[dict]) -> str | None:
    """The hash that the candidate and every keeper with files and hashes have, SHA-1 first; None if there is none."""
    for h in ("sha1", "md5"):
        if h in candidate["hashes"] and all(h in k["hashes"] for k in keepers if k["hashes"]):
            return h
    return None


def negotiate_diff(snapshots: list[dict]) -> str | None:
    """The hash that every snapshot of both sides has, SHA-1 first."""
    return next((h for h in ("sha1", "md5") if all(h in s["hashes"] for s in snapshots)), None)
