"""Totals, search, listing and upserts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, values


def totals(files: DataFrame, min_size: int = 0) -> DataFrame:
    """n_files and n_bytes of the files of at least min_size."""
    return files.where(F.col("size_bytes") >= min_size).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("n_bytes"))


def has_sizes(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.bool_or(F.col("size_bytes") > 0), F.lit(False)).alias("has_sizes"))


def detect_hashes(files: DataFrame) -> DataFrame:
    """Which hashes any file has."""
    some = lambda c: F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)).alias(f"has_{c}")
    return files.agg(some("sha1"), some("md5"))


def find(files: DataFrame, pattern: str, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Files whose name fits a shell pattern, or in which a regular expression is found."""
    name = paths.basename(F.col("path"))
    return files.where(values.matches_regex(name, pattern, case_sensitive) if regex else values.matches_glob(name, pattern, case_sensitive))


def latest(files: DataFrame, keys=("path",), order=("seq",)) -> DataFrame:
    """The last written row of each key (upserts): a group is reduced before it is shuffled."""
    rest = [c for c in files.columns if c not in keys]
    best = files.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in files.columns])


def listing(catalog: DataFrame) -> DataFrame:
    """Snapshots, the last finished first; unfinished ones at the end."""
    return catalog.orderBy(F.desc_nulls_last("finished_at"), F.desc("id"))


def merge(inputs: list[DataFrame]) -> DataFrame:
    """path, size_bytes, sha1, md5 and input of each path; of a path in several inputs the last one's."""
    return latest(_numbered(inputs), ("path",), ("input",))


def _numbered(inputs: list[DataFrame]) -> DataFrame:
    out = None
    for i, df in enumerate(inputs):
        x = df.select("path", "size_bytes", "sha1", "md5", F.lit(i).cast("bigint").alias("input"))
        out = x if out is None else out.unionByName(x)
    return out


def conflicts(inputs: list[DataFrame]) -> DataFrame:
    """path, input, had and has of each record whose content (sha1, else md5) is not that of the path's record before it."""
    h = F.coalesce("sha1", "md5", F.lit(""))
    w = Window.partitionBy("path").orderBy("input")
    rows = _numbered(inputs).select("path", "input", h.alias("has"))
    rows = rows.withColumn("had", F.lag("has").over(w))
    return rows.where("had is not null and had <> has").select("path", "input", "had", "has")


def merge_counters(inputs: list[DataFrame]) -> DataFrame:
    """n_records, n_unique, n_collapsed and n_conflicts of a merge."""
    h = F.coalesce("sha1", "md5", F.lit(""))
    w = Window.partitionBy("path").orderBy("input")
    rows = _numbered(inputs).select("path", h.alias("h"), F.lag(h).over(w).alias("before"), F.row_number().over(w).alias("k"))
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return rows.agg(F.count("*").alias("n_records"), one(F.col("k") == 1).alias("n_unique"), one(F.col("k") > 1).alias("n_collapsed"), one(F.col("before") != F.col("h")).alias("n_conflicts"))


def clashes(files: DataFrame) -> DataFrame:
    """path of each file that also is a directory above another file."""
    p = paths.parts(F.col("path"))
    own = files.select(paths.joined(p).alias("path"))
    # only the parents of files and theirs can clash: each directory is looked up once
    up = files.select(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))).alias("d")).distinct().select(F.explode(paths.ancestors(F.col("d"), True)).alias("path")).distinct()
    return own.join(up, "path", "left_semi").distinct()


def relativised(files: DataFrame, root: str, excludes=()) -> DataFrame:
    """Files with paths relative to root and without the excluded ones."""
    p = F.col("path")
    kept = files.where(~paths.excluded(p, root, excludes)) if excludes else files
    return kept.withColumn("path", paths.relative(p, root))


def combined(sides: list[tuple[DataFrame, str]], excludes=()) -> DataFrame:
    """One side of a diff from several snapshots (files, root); reading it fails if two hold the same path."""
    out = None
    for files, root in sides:
        x = relativised(files, root, excludes).select("path", "size_bytes", "sha1", "md5")
        out = x if out is None else out.unionByName(x)
    if len(sides) == 1:
        return out
    n = F.count("*").alias("n")
    first = lambda c: F.first(c).alias(c)
    rows = out.groupBy("path").agg(n, first("size_bytes"), first("sha1"), first("md5"))
    refuse: Column = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two sources hold the path "), F.col("path")))).otherwise(F.col("path"))
    return rows.select(refuse.alias("path"), "size_bytes", "sha1", "md5")
