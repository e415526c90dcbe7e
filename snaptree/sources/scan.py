"""Scan of a directory tree that all executors see at the same path: they list, then they hash."""
from __future__ import annotations

import datetime as dt
import os
import stat
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..tables import saved

#: Bytes read at a time; files in a task and in a write, about; directories that a task lists before it hands on the rest.
CHUNK, FILES_PER_TASK, FILES_PER_WRITE, DIRS_PER_TASK = 1 << 20, 2000, 200_000, 2000
#: Messages of unreadable files that a scan reports.
SAMPLES = 10
LISTED = "path string, size_bytes bigint, mod_time timestamp"


def _list(device: int, mounts: str):
    """Directories to rows of files, of what could not be read (error), and of directories left to the next round (more)."""

    def walk(top: str):
        try:
            with os.scandir(top) as entries:
                found = sorted(entries, key=lambda e: e.name)
        except OSError as e:
            yield top, None, None, str(e), False
            return
        for e in found:
            try:
                s = e.stat(follow_symlinks=False)
            except OSError as x:
                yield e.path, None, None, str(x), False
                continue
            if stat.S_ISDIR(s.st_mode):
                if s.st_dev != device and mounts == "fail":
                    raise OSError(f"{e.path} is another file system")
                if s.st_dev == device or mounts == "cross":
                    yield e.path, None, None, None, True
            elif stat.S_ISREG(s.st_mode):
                yield e.path, s.st_size, dt.datetime.fromtimestamp(s.st_mtime, dt.timezone.utc), None, False

    def run(batches):
        for b in batches:
            left, done, out = deque(b["path"]), 0, []
            while left:
                top = left.popleft()
                if done >= DIRS_PER_TASK:
                    out.append((top, None, None, None, True))
                    continue
                done += 1
                for row in walk(top):
                    left.append(row[0]) if row[4] else out.append(row)
                if len(out) > 10_000:
                    yield _frame(out)
                    out = []
            yield _frame(out)

    return run


def _frame(rows: list) -> pd.DataFrame:
    x = pd.DataFrame(rows, columns=["path", "size_bytes", "mod_time", "error", "more"])
    return x.assign(size_bytes=x.size_bytes.astype("Int64"), mod_time=pd.to_datetime(x.mod_time, utc=True), more=x.more.astype(bool))


def walked(spark: SparkSession, root: str, mounts: str = "stay") -> DataFrame:
    """path, size_bytes, mod_time, error of the regular files below root, and of what could not be listed (error is set).

    mounts: stay (leave other file systems out), cross (go into them) or fail (refuse them).  Symbolic links are not
    followed.  Executors list in rounds, each DIRS_PER_TASK directories at most, so no host holds the tree.
    """
    root = os.path.abspath(root)
    device = os.lstat(root).st_dev
    todo, rounds = spark.createDataFrame([(root,)], "path string"), []
    while True:
        level = saved(todo.mapInPandas(_list(device, mounts), f"{LISTED}, error string, more boolean"))
        rounds.append(level.where("not more").drop("more"))
        more = level.where("more").select("path")
        n = more.count()
        if not n:
            break
        todo = more.repartition(max(1, min(n, spark.sparkContext.defaultParallelism * 4)))
    out = rounds[0]
    for x in rounds[1:]:
        out = out.unionByName(x)
    return out


def listed(spark: SparkSession, root: str, mounts: str = "stay") -> DataFrame:
    """path, size_bytes, mod_time of the regular files below root that could be read; see walked()."""
    return walked(spark, root, mounts).where("error is null").drop("error")


def estimate(root: str, cross: bool = False) -> int:
    """Bytes in use on root's file system and, with cross, on those mounted below it: about what a scan will find."""
    used = lambda p: (lambda v: (v.f_blocks - v.f_bfree) * v.f_frsize)(os.statvfs(p))
    total = used(root)
    if cross:
        top = os.path.abspath(root).rstrip("/") + "/"
        with open("/proc/mounts") as f:
            below = {m for m in (line.split()[1].encode().decode("unicode_escape") for line in f) if m.startswith(top) and m != top}
        for m in sorted(below):
            try:
                total += used(m)
            except OSError:
                continue
    return total


def _hash(md5: bool):
    def run(batches):
        import hashlib

        for b in batches:
            out = []
            for p in b["path"]:
                h = [hashlib.sha1(), *([hashlib.md5()] if md5 else [])]
                try:
                    with open(p, "rb") as f:
                        while block := f.read(CHUNK):
                            for x in h:
                                x.update(block)
                    out.append((h[0].hexdigest(), h[1].hexdigest() if md5 else None, None))
                except OSError as e:
                    out.append((None, None, str(e)))
            yield b.assign(sha1=pd.Series([o[0] for o in out], dtype=object), md5=pd.Series([o[1] for o in out], dtype=object), error=pd.Series([o[2] for o in out], dtype=object))

    return run


def hashed(files: DataFrame, md5: bool = False) -> DataFrame:
    """files with sha1, md5 and error (null if it could be read); each file is read once."""
    tasks = max(1, files.count() // FILES_PER_TASK)
    return files.select("path", "size_bytes", "mod_time").repartition(tasks).mapInPandas(_hash(md5), f"{LISTED}, sha1 string, md5 string, error string")


def unfinished(listing: DataFrame, have: DataFrame, md5: bool = False, no_hash: bool = False) -> DataFrame:
    """What a resumed scan has still to read: files that are not there with the same size and all the hashes wanted."""
    wanted = F.lit(True) if no_hash else F.col("sha1").isNotNull() & (F.col("md5").isNotNull() if md5 else F.lit(True))
    return listing.join(have.where(wanted).select("path", "size_bytes"), ["path", "size_bytes"], "left_anti")


def _begin(store, root: str, name: str, resume_from: str | None, force_new: bool) -> tuple[dict, bool]:
    """(row of the snapshot that the scan writes to, whether it is an earlier one)."""
    if resume_from is not None:
        row = store.resolve(resume_from)
        if row["status"] == "failed":
            raise ValueError(f"the snapshot {row['name']} failed and cannot be resumed")
        return row, True
    last = store.last_of_root(root)
    if last and last["status"] == "in_progress":
        if not force_new:
            return last, True
        if last["name"] == name:
            store.supersede(last)
    return store.create(store.free_name(name), root, os.uname().nodename), False


def snapshot(spark: SparkSession, store, root: str, name: str, md5: bool = False, no_hash: bool = False, mounts: str = "stay", resume_from: str | None = None, force_new: bool = False, record_as: str | None = None) -> dict:
    """Records root in the store; the row of the snapshot, with `samples` of what could not be read and `warnings`.

    A scan of the same root that was interrupted is gone on with, unless force_new is set (one of the same name
    is renamed then); resume_from names the snapshot to go on with.  record_as: the root under which files are
    recorded instead of their own.  Files are written as they are hashed, FILES_PER_WRITE at a time, so that a later
    scan reads only the rest.  What cannot be listed or read is counted, and the snapshot is failed.
    """
    root = os.path.abspath(root)
    kept_as = record_as or root
    row, resumed = _begin(store, kept_as, name, resume_from, force_new)
    found = saved(walked(spark, root, mounts))
    listing, errors = found.where("error is null").drop("error"), found.where("error is not null").select("path", "error")
    back = lambda df: df.withColumn("path", paths.rebased(F.col("path"), root, kept_as)) if kept_as != root else df
    todo = unfinished(back(listing), store.files(row), md5, no_hash) if resumed else back(listing)
    if no_hash:
        store.write(row, todo)
    else:
        todo = saved(todo)
        writes = -(-todo.count() // FILES_PER_WRITE)
        for k in range(writes):
            part = todo.where(F.pmod(F.xxhash64("path"), F.lit(writes)) == k)
            part = part.withColumn("path", paths.rebased(F.col("path"), kept_as, root)) if kept_as != root else part
            done = saved(hashed(part, md5))
            store.write(row, back(done.where("error is null").drop("error")))
            errors = errors.unionByName(done.where("error is not null").select("path", "error"))
    n = errors.count()
    out = store.finish(row, n)
    bytes_ = found.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    few = bytes_ < 0.5 * estimate(root, mounts == "cross") and os.path.ismount(root)
    return out | {"samples": [f"{r.path}: {r.error}" for r in errors.orderBy("path").limit(SAMPLES).collect()], "warnings": ["less than half of the file system's used bytes were found; files may be missing for lack of permission"] if few else []}
