"""The two-file text format: `hash  utf-8  base64 path` and `bytes  utf-8  base64 path`."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import hash_or_null


def lines(files: DataFrame) -> DataFrame:
    """hash_line and size_line of each file; a missing MD5 is written as `-`."""
    path = F.base64(F.encode("path", "utf-8"))
    # encoders that break long lines must not break a record
    path = F.regexp_replace(path, r"[\r\n]", "")
    row = lambda x: F.concat_ws("  ", x, F.lit("utf-8"), path)
    return files.select(row(F.coalesce("md5", F.lit("-"))).alias("hash_line"), row(F.col("size_bytes").cast("string")).alias("size_line"))


def export(files: DataFrame, hashes: str, sizes: str) -> None:
    rows = lines(files)
    rows.select("hash_line").write.mode("errorifexists").text(hashes)
    rows.select("size_line").write.mode("errorifexists").text(sizes)


def parse(hashes: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """path, size_bytes, sha1 and md5 from lines (value); malformed lines are left out, `-` is no hash.

    Files without a size line, and all files without sizes, have size 0.
    """
    f = F.split("value", "  ")
    one = lambda df, c, name: df.where(F.size(f) == 3).select(F.decode(F.unbase64(f[2]), "utf-8").alias("path"), c.alias(name))
    rows = one(hashes, hash_or_null(f[0]), "md5")
    if sizes is None:
        rows = rows.withColumn("size_bytes", F.lit(0).cast("bigint"))
    else:
        s = one(sizes, F.trim(f[0]).try_cast("bigint"), "size_bytes")
        s = s.groupBy("path").agg(F.max("size_bytes").alias("size_bytes"))
        rows = rows.join(s, "path", "left").withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0)))
    return rows.select("path", "size_bytes", F.lit(None).cast("string").alias("sha1"), "md5")


def read(spark: SparkSession, hashes: str, sizes: str | None = None) -> DataFrame:
    return parse(spark.read.text(hashes), spark.read.text(sizes) if sizes else None)


def common_root(files: DataFrame) -> str:
    """The lowest directory above all files: what the least and the greatest path have in common."""
    r = files.agg(F.min("path").alias("a"), F.max("path").alias("b")).first()
    if r["a"] is None:
        return ""
    a, b = r["a"].split("/")[:-1], r["b"].split("/")[:-1]
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return "/".join(a[:n]) or ("/" if r["a"].startswith("/") else "")
