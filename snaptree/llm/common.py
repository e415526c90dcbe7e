"""Helpers that several operators share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cleaned, saved  # noqa: F401  # the operators take them from here

#: White space that parts words (fixed value).
WHITESPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever characters their names hold."""
    return [col(c) for c in df.columns]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITESPACE), lambda w: w != "")


def tasks_for(df: DataFrame, mb_each: float, least: int = 1) -> int:
    """Number of tasks so that each gets about mb_each of df's source bytes."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, min(1_000_000, int(size / 1e6 / mb_each) + 1))


#: Bits of the filter that split_by() broadcasts: 1 MB, whatever the number of ids.
FILTER_BITS = 1 << 23


def split_by(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose key may be in ids, rows whose key is surely not), by a hashed bitmap of a fixed size.

    It spares the shuffle of rows that a join with ids would not touch; with many ids the first part nears df.
    Null keys are in the second part.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bucket, bits = fresh(df, "bucket", "bits")
    marks = ids.select(at(ids.columns[0]).alias("p")).groupBy(F.bitmap_bucket_number("p").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(bits))
    marks = F.broadcast(saved(marks))  # FILTER_BITS / 8 bytes at most
    p = F.when(col(key).isNotNull(), at(col(key).cast("bigint")))
    tested = df.withColumn(bucket, F.bitmap_bucket_number(p)).join(marks, bucket, "left")
    bit = F.bitmap_bit_position(p)
    byte = F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1, F.lit(False))
    return tested.where(hit).select(*columns(df)), tested.where(~hit).select(*columns(df))
