"""Reads snapshots from an SQLite file of tables snapshots and files, and converts them into a store."""
from __future__ import annotations

import re
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.values import hash_or_null, timestamp

#: Columns of the table of files (fixed values).
COLUMNS = ["path", "filename", "size_bytes", "mod_time", "sha1", "md5"]
#: Rows that a task reads from the file at a time; rows in a task.
FETCH, ROWS_PER_TASK = 5000, 200_000


def snapshots(path: str) -> list[dict]:
    """Rows of the catalog; columns that an older file lacks are None."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        db.row_factory = sqlite3.Row
        rows = [dict(r) for r in db.execute("SELECT * FROM snapshots ORDER BY id")]
    return [{"computer_name": None, "error_count": 0} | r | {"hashes": [h for h in (r.get("hashes") or "").split(",") if h]} for r in rows]


def files(spark: SparkSession, path: str, snapshot_id: int) -> DataFrame:
    """path, filename, size_bytes, mod_time, sha1, md5 of a snapshot, read in ranges of row ids by the tasks.

    Columns that an older file lacks are null.  The file has to be at the same path on all executors.
    """
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute("SELECT min(id), max(id) FROM files WHERE snapshot_id = ?", (snapshot_id,)).fetchone()
        there = {r[1] for r in db.execute("PRAGMA table_info(files)")}
    low, high = low or 0, high or -1
    chosen = ", ".join((f"CAST({c} AS TEXT)" if c == "mod_time" else c) if c in there else f"NULL AS {c}" for c in COLUMNS)

    def read(batches):
        import pandas as pd

        for b in batches:
            for a in b["id"]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    cur = db.execute(f"SELECT {chosen} FROM files WHERE snapshot_id = ? AND id >= ? AND id < ?", (snapshot_id, int(a), int(a) + ROWS_PER_TASK))
                    while rows := cur.fetchmany(FETCH):
                        x = pd.DataFrame(rows, columns=COLUMNS)
                        yield x.assign(size_bytes=x.size_bytes.astype("Int64"))

    starts = spark.range(low, high + 1, ROWS_PER_TASK, max(1, (high - low) // ROWS_PER_TASK + 1))
    rows = starts.mapInPandas(read, "path string, filename string, size_bytes bigint, mod_time string, sha1 string, md5 string")
    name = F.coalesce("filename", paths.basename(F.col("path")))
    return rows.withColumns({"filename": name, "size_bytes": F.coalesce("size_bytes", F.lit(0)), "mod_time": timestamp(F.col("mod_time")), "sha1": hash_or_null(F.col("sha1")), "md5": hash_or_null(F.col("md5"))})


def corrected_root(root: str, name: str) -> str:
    """The dataset that the snapshot is named after, if its root is a scan's temporary mount (`...-zfsscan-<number>`, whatever comes before)."""
    usable = bool(name) and not name.startswith("/") and not name.endswith("/") and not re.search(r"[ \t\n]", name)
    return name if usable and re.search(r"(?:^|/)[^/]*-zfsscan-[0-9]+/?$", root) else root


def _instant(spark: SparkSession, text: str | None):
    import datetime as dt

    if text is None:
        return None
    row = spark.createDataFrame([(str(text),)], "t string").select(F.unix_micros(timestamp(F.col("t"))).alias("t")).first()
    return None if row["t"] is None else dt.datetime.fromtimestamp(row["t"] / 1e6, dt.timezone.utc)


def convert(spark: SparkSession, path: str, store, rebase: bool = True) -> list[dict]:
    """Copies all snapshots that are not deleted into a store, as they are: status, dates, hashes and errors are kept.

    A run that was interrupted is finished by another one: a snapshot whose whole copy (same name, dates, status and
    number of files) is in the store is skipped, and one that was left in progress by a conversion is deleted and copied anew.
    """
    out = []
    for s in snapshots(path):
        if s["status"] == "deleted":
            continue
        root = corrected_root(s["root_path"], s["name"]) if rebase else s["root_path"]
        rows = files(spark, path, s["id"]).withColumn("path", paths.rebased(F.col("path"), s["root_path"], root))
        facts = {"name": s["name"], "root_path": root, "computer_name": s["computer_name"], "started_at": _instant(spark, s.get("started_at")), "finished_at": _instant(spark, s.get("finished_at")), "status": s["status"], "hashes": s["hashes"], "error_count": s["error_count"] or 0}
        mark = f"convert:{s['id']}"
        whole = False
        for old in store.catalog().where((F.col("computer_name") == mark) & (F.col("status") == "in_progress")).collect():
            store.delete(old.asDict())
        named = (F.col("name") == s["name"]) | F.col("name").startswith(s["name"] + "_")
        alike = (F.col("root_path") == root) & (F.col("status") == s["status"]) & F.col("started_at").eqNullSafe(F.lit(facts["started_at"]).cast("timestamp"))
        for old in store.catalog().where(named & alike).collect():
            whole = whole or store.files(old.asDict()).count() == rows.select("path").distinct().count()
        if whole:
            continue
        # until it is whole, the copy is marked as a conversion's and in progress
        new = store.create(store.free_name(s["name"]), root, mark)
        store.write(new, rows)
        row = new | facts | {"name": new["name"]}
        store.put(row)
        out.append(row)
    return out
