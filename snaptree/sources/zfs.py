"""Dataset listings and the plan of a scan over them."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a listing, in order (fixed values).
FIELDS = ("name", "mountpoint", "mounted", "canmount", "type", "referenced")


def parse(lines: DataFrame) -> DataFrame:
    """The datasets of tab-separated lines (value); reading a line that has not six fields fails."""
    f = F.split("value", "\t")
    ok = F.when(F.size(f) == len(FIELDS), f).otherwise(F.raise_error(F.concat(F.lit("not a dataset line: "), F.col("value"))).cast("array<string>"))
    rows = lines.where(F.trim("value") != "").select(ok.alias("f"))
    cols = [F.col("f")[i].alias(c) for i, c in enumerate(FIELDS)]
    rows = rows.select(*cols)
    return rows.withColumns({"mounted": F.col("mounted") == "yes", "referenced": F.col("referenced").try_cast("bigint")}).orderBy("name")


def plan(datasets: DataFrame, seen: DataFrame, excludes=(), include_canmount_off: bool = False, force_new: bool = False) -> DataFrame:
    """datasets with plan: excluded, volume, canmount_off, already_done, failed (to be deleted first), resume or scan.

    seen: id, name and status of earlier snapshots, of which a name's newest counts; with force_new none does.
    """
    name = F.col("name")
    out = reduce(lambda a, x: a | (name == x) | name.startswith(x.rstrip("/") + "/"), [x.strip() for x in excludes if x.strip()], F.lit(False))
    last = seen.groupBy("name").agg(F.max_by("status", "id").alias("_last"))
    rows = datasets.join(last, "name", "left")
    before = F.when(F.lit(force_new), F.lit(None)).otherwise(F.col("_last"))
    off = F.lit(not include_canmount_off) & (F.col("canmount") == "off")
    step = F.when(out, "excluded").when(F.col("type") == "volume", "volume").when(off, "canmount_off")
    step = step.when(before == "completed", "already_done").when(before == "failed", "failed").when(before == "in_progress", "resume").otherwise("scan")
    return rows.withColumn("plan", step).drop("_last")


def scan(spark: SparkSession, store, datasets: DataFrame, mounted, excludes=(), include_canmount_off: bool = False, force_new: bool = False, **options) -> list[dict]:
    """Scans the datasets that the plan names, one after another, each recorded under its own name; name, plan and outcome of each.

    mounted(name) is a context manager that gives the folder at which the executors find the dataset.  An earlier failed
    snapshot is deleted first, an unfinished one is gone on with.  One dataset's failure does not end the run: its outcome
    tells the error.  options go to scan.snapshot().
    """
    from . import scan as tree

    steps = plan(datasets, store.catalog().where("status <> 'deleted'").select("id", F.col("root_path").alias("name"), "status"), excludes, include_canmount_off, force_new)
    out = []
    for r in steps.orderBy("name").select("name", "plan").collect():
        name, step = r["name"], r["plan"]
        if step not in ("scan", "resume", "failed"):
            out.append({"name": name, "plan": step, "outcome": "skipped"})
            continue
        try:
            if step == "failed":
                store.delete(store.last_of_root(name))
            with mounted(name) as folder:
                row = tree.snapshot(spark, store, folder, name, record_as=name, force_new=force_new, **options)
            out.append({"name": name, "plan": step, "outcome": row["status"], "id": row["id"]})
        except Exception as e:  # noqa: BLE001  # the run goes on with the next dataset
            out.append({"name": name, "plan": step, "outcome": f"error: {e}"})
    return out
