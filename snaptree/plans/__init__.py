"""What a plan holds, for tests that keep it good."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame


def text(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def joins(df: DataFrame) -> list[str]:
    return re.findall(r"\w+Join|CartesianProduct", text(df).split("\n\n")[0])


def pairs_all(df: DataFrame) -> bool:
    """True if the plan pairs rows without an equality."""
    return bool(re.search("CartesianProduct|BroadcastNestedLoopJoin", text(df)))


def exchanges(df: DataFrame) -> int:
    return len(re.findall(r"(?m)^[\s:+-]*(?:\* )?Exchange \(", text(df)))


def runs_python(df: DataFrame) -> bool:
    return bool(re.search("Python|Pandas|MapInArrow|FlatMapGroupsInArrow", text(df)))


def read_columns(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: struct<(.*?)>\n", text(df))


def pushed(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*?)\]", text(df))
