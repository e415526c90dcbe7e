"""Duplicate files and directories, reported at the highest level."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..tables import cleaned, saved
from .tree import below, digest, entry_words


def nodes(files: DataFrame) -> DataFrame:
    """path, is_dir, key, size_bytes and n_files of each file and directory; key: null without any hash."""
    p = paths.parts(F.col("path"))
    rows = files.select(paths.joined(p).alias("path"), p.alias("p"), F.coalesce("sha1", "md5").alias("h"), "size_bytes")
    one = rows.select("path", F.lit(False).alias("is_dir"), F.concat(F.lit("f:"), "h").alias("key"), "size_bytes", F.lit(1).cast("bigint").alias("n_files"))
    up = rows.select("path", "h", "size_bytes", F.explode(paths.ancestors(F.col("p"))).alias("up"))
    words = entry_words(below(F.col("path"), F.col("up")), F.col("h"))
    up = up.select("up", "size_bytes", *[F.when(F.col("h").isNotNull(), w).alias(f"d{i}") for i, w in enumerate(words)])
    dirs = up.groupBy("up").agg(digest("d").alias("key"), F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("n_files"))
    return one.unionByName(dirs.select(F.col("up").alias("path"), F.lit(True).alias("is_dir"), F.concat(F.lit("d:"), "key").alias("key"), "size_bytes", "n_files"))


@cleaned
def duplicates(files: DataFrame, min_size: int = 0) -> DataFrame:
    """group_path, path, is_dir, size_bytes, n_files, n_members: the members of each reported group.

    A group has two nodes or more of equal content, one at least of min_size.  It is reported if any
    member has no directory above it that belongs to a group itself.  group_path: its least path.
    """
    all_ = saved(nodes(files).where("key is not null"))
    group = all_.groupBy("key").agg(F.count("*").alias("n_members"), F.max("size_bytes").alias("largest"), F.min("path").alias("group_path"))
    group = group.where((F.col("n_members") >= 2) & (F.col("largest") >= min_size)).drop("largest")
    member = saved(all_.join(group, "key"))
    above = member.where("is_dir").select(F.col("path").alias("up")).distinct()
    # whether a member is in such a directory is known from its parent; the root is never equal to another directory
    member = member.withColumn("parent", paths.parent(F.col("path")))
    up = member.where("parent <> ''").select("parent").distinct().select("parent", F.explode(paths.ancestors(F.split("parent", "/"), True)).alias("up"))
    covered = up.join(above, "up", "left_semi").select("parent").distinct()
    top = member.join(covered, "parent", "left_anti").select("key").distinct()
    return member.join(top, "key", "left_semi").select("group_path", "path", "is_dir", "size_bytes", "n_files", "n_members")


def wasted(found: DataFrame, limit: int = 0) -> DataFrame:
    """group_path, is_dir, n_members, wasted_bytes of each group, the most wasteful first; limit 0: all."""
    rows = found.groupBy("group_path", "is_dir", "n_members").agg(F.max("size_bytes").alias("s"))
    rows = rows.select("group_path", "is_dir", "n_members", ((F.col("n_members") - 1) * F.col("s")).alias("wasted_bytes"))
    rows = rows.orderBy(F.desc("wasted_bytes"), "group_path", "is_dir")
    return rows.limit(limit) if limit else rows


def total_wasted(found: DataFrame) -> DataFrame:
    """n_groups and wasted_bytes over all groups, whatever number of them is listed."""
    return wasted(found).agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("wasted_bytes"), F.lit(0)).cast("bigint").alias("wasted_bytes"))
