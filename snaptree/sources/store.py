"""A store of snapshots: Parquet files partitioned by snapshot, and an append-only catalog.

Each change of a snapshot appends its new row to the catalog with a higher version; the last one counts.  A
snapshot's files are written before the row that completes it, so a reader never sees half of one.  A store has
one writer at a time: numbers are the largest so far and one.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.errors import AnalysisException

from ..functions import paths
from ..operators import basic
from ..schema import FILES, SNAPSHOTS, STATUSES, VERSION
from ..tables import remove

#: Paths of conflicts that a merge reports.
SAMPLES = 10


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        if self.layout() > VERSION:
            raise ValueError(f"{path} has layout {self.layout()}; this program knows {VERSION}")

    def layout(self) -> int:
        """Version of the layout that the store was written with; VERSION for a new one."""
        try:
            return self.spark.read.schema("layout int").parquet(f"{self.path}/layout").agg(F.max("layout")).first()[0] or VERSION
        except AnalysisException:
            return VERSION

    def _versions(self) -> DataFrame:
        schema = StructType([*SNAPSHOTS.fields, StructField("version", LongType())])
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/catalog")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def catalog(self) -> DataFrame:
        """The current row of each snapshot."""
        return basic.latest(self._versions(), ("id",), ("version",)).drop("version")

    def listing(self) -> DataFrame:
        return basic.listing(self.catalog())

    def put(self, row: dict) -> None:
        """Appends the row of a snapshot to the catalog."""
        if row["status"] not in STATUSES:
            raise ValueError(f"not a status: {row['status']}")
        n = self._versions().agg(F.max("version")).first()[0] or 0
        schema = StructType([*SNAPSHOTS.fields, StructField("version", LongType())])
        self.spark.createDataFrame([tuple(row.get(f.name) for f in SNAPSHOTS.fields) + (n + 1,)], schema).coalesce(1).write.mode("append").parquet(f"{self.path}/catalog")

    def resolve(self, ref: str) -> dict:
        """The snapshot of a number or, newest first, of a name; deleted ones do not count."""
        rows = self.catalog().where(F.col("status") != "deleted")
        found = rows.where(F.col("id") == int(ref)).first() if ref.isdigit() else None
        found = found or rows.where(F.col("name") == ref).orderBy(F.desc("id")).first()
        if found is None:
            raise KeyError(f"no snapshot {ref}")
        return found.asDict()

    def last_of_root(self, root: str) -> dict | None:
        found = self.catalog().where((F.col("root_path") == root) & (F.col("status") != "deleted")).orderBy(F.desc("id")).first()
        return found.asDict() if found else None

    def free_name(self, name: str, exact: bool = False, now: dt.datetime | None = None) -> str:
        """name, or if it is taken name_HHMMSS, then name_HHMMSS_1 and so on; with exact a taken name is an error.  Names of deleted ones are free."""
        now = now or dt.datetime.now(dt.timezone.utc)
        stamped = f"{name}_{now:%H%M%S}"
        wanted = [name, stamped, *(f"{stamped}_{i}" for i in range(1, 100))]
        taken = {r[0] for r in self.catalog().where(F.col("name").isin(wanted) & (F.col("status") != "deleted")).select("name").distinct().collect()}
        if exact and name in taken:
            raise ValueError(f"the name {name} is taken")
        free = next((x for x in wanted if x not in taken), None)
        if free is None:
            raise ValueError(f"no free name for {name}")
        return free

    def create(self, name: str, root: str, computer: str = "") -> dict:
        top = self._versions().agg(F.max("id")).first()[0]
        if top is None:
            self.spark.createDataFrame([(VERSION,)], "layout int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/layout")
            top = 0
        row = {"id": top + 1, "name": name, "root_path": root, "computer_name": computer, "started_at": dt.datetime.now(dt.timezone.utc), "status": "in_progress", "hashes": [], "error_count": 0}
        self.put(row)
        return row

    def write(self, snapshot: dict, files: DataFrame) -> None:
        """Adds files; a path that is there already is replaced when it is read."""
        name = paths.basename(F.col("path")) if "filename" not in files.columns else F.col("filename")
        rows = files.withColumn("filename", name)
        for f in FILES.fields:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        n = self.files(snapshot, raw=True).agg(F.max("seq")).first()[0] or 0
        rows.select(*FILES.fieldNames(), F.lit(n + 1).cast("bigint").alias("seq")).write.mode("append").parquet(f"{self.path}/files/snapshot_id={snapshot['id']}")

    def files(self, snapshot: dict, raw: bool = False) -> DataFrame:
        """The snapshot's files, of one path the last written."""
        schema = StructType([*FILES.fields, StructField("seq", LongType())])
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/files/snapshot_id={snapshot['id']}")
        except AnalysisException:
            rows = self.spark.createDataFrame([], schema)
        return rows if raw else basic.latest(rows, ("path",), ("seq",)).drop("seq")

    def finish(self, snapshot: dict, errors: int = 0) -> dict:
        """Completes a snapshot, or marks it failed if there were errors; its hashes are looked up.

        A snapshot that holds a path as a file and as a directory is refused: no single tree can.
        """
        clash = basic.clashes(self.files(snapshot, raw=True)).first()
        if clash is not None:
            raise ValueError(f"{clash['path']} is a file and a directory in {snapshot['name']}")
        has = basic.detect_hashes(self.files(snapshot, raw=True)).first()
        row = snapshot | {"finished_at": dt.datetime.now(dt.timezone.utc), "status": "failed" if errors else "completed", "error_count": errors, "hashes": [h for h in ("sha1", "md5") if has[f"has_{h}"]]}
        self.put(row)
        return row

    def supersede(self, snapshot: dict) -> dict:
        row = snapshot | {"name": f"{snapshot['name']}_superseded_{snapshot['id']}"}
        self.put(row)
        return row

    def delete(self, snapshot: dict) -> None:
        """Leaves a tombstone and removes the files; doing it again changes nothing."""
        self.put(snapshot | {"status": "deleted"})
        remove(self.spark, f"{self.path}/files/snapshot_id={snapshot['id']}")

    def take(self, files: DataFrame, facts: dict) -> dict:
        """A new snapshot of files with the name (a free one like it), root, status, dates, hashes and errors of facts."""
        new = self.create(self.free_name(facts["name"]), facts["root_path"], facts["computer_name"] or "")
        self.write(new, files)
        row = new | {k: facts[k] for k in ("started_at", "finished_at", "status", "hashes", "error_count")}
        self.put(row)
        return row

    def copy_from(self, other: Store, ref: str) -> dict:
        """Copies a snapshot of another store under a free name."""
        src = other.resolve(ref)
        return self.take(other.files(src), src)

    def copy_all(self, other: Store) -> list[dict]:
        """Copies all snapshots of another store that are not deleted, the oldest first."""
        refs = other.catalog().where("status <> 'deleted'").orderBy("id").select("id").collect()
        return [self.copy_from(other, str(r["id"])) for r in refs]

    def warnings(self, *snapshots: dict) -> list[str]:
        return [f"{s['name']} is {s['status']}" for s in snapshots if s["status"] != "completed"]

    def merge(self, refs: list[str], name: str) -> dict:
        """A new snapshot of several: of a path in more than one, the last one's record.

        The row has the counters of the merge and `samples` of paths whose content was replaced.  Roots of which none
        lies in another have no path in common, and nothing is compared then.
        """
        src = [self.resolve(r) for r in refs]
        files = [self.files(s) for s in src]
        new = self.create(self.free_name(name), paths.common_root([s["root_path"] for s in src]))
        if paths.disjoint([s["root_path"] for s in src]):
            rows = files[0]
            for x in files[1:]:
                rows = rows.unionByName(x)
            self.write(new, rows)
            n = rows.count()
            return self.finish(new) | {"n_records": n, "n_unique": n, "n_collapsed": 0, "n_conflicts": 0, "samples": []}
        self.write(new, basic.merge(files).drop("input"))
        counters = basic.merge_counters(files).first().asDict()
        samples = [r["path"] for r in basic.conflicts(files).select("path").distinct().orderBy("path").limit(SAMPLES).collect()]
        return self.finish(new) | counters | {"samples": samples}
