"""Ranks within groups that no single task has to hold."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import saved


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with each row's rank, from 1, in its group.

    Rows are dealt into ranges of keys and order, so a group that holds most rows is spread; ranks within
    a range are moved by the counts of the group's earlier ranges.
    """
    by = [*keys, *order]
    dealt = saved(df.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()))
    own = Window.partitionBy("_p", *keys).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = saved(dealt.groupBy("_p", *keys).agg(F.count("*").alias("_n")).withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    rows = dealt.withColumn("_r", F.row_number().over(own)).join(shift, ["_p", *keys])
    return rows.withColumn(name, (F.col("_r") + F.col("_s")).cast("bigint")).drop("_p", "_r", "_s")
