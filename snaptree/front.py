"""Whole operations over a store: names are resolved, a hash is agreed on, doubts are told, and an operator is run."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import paths, values
from .operators import basic, coverage, diff, dupes
from .tables import saved

#: Lines of uncovered files that are listed if no other number is given.
LISTED = 50


@dataclass
class Report:
    """What an operation found: rows to show, figures over all rows (also those not shown), and warnings."""

    rows: DataFrame | None
    figures: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    hash_type: str | None = None


def _agreed(hash_type: str | None, found: str | None) -> str:
    if found is None:
        raise ValueError("the snapshots share no hash")
    return hash_type or found


def compare(store, old: list[str], new: list[str], excludes=(), moves: bool = True, copies: bool = True, show_unchanged: bool = False, budget: int = 0, update: bool = False) -> Report:
    """The diff of the snapshots `old` and `new` (several on a side are read as one, and may not hold the same path).

    SHA-1 is compared if all have it, else MD5; without a common hash the diff is refused.  Excludes are taken from both sides.
    """
    if not old or not new:
        raise ValueError("a diff takes a snapshot at least on each side")
    sides = [[store.resolve(r) for r in refs] for refs in (old, new)]
    h = _agreed(None, coverage.negotiate_diff([s for side in sides for s in side]))
    a, b = (basic.combined([(store.files(s), s["root_path"]) for s in side], excludes) for side in sides)
    root_a, root_b = (side[0]["root_path"] if len(side) == 1 else "" for side in sides)
    rows = diff.diff(a, b, root_a, root_b, h, moves, copies, show_unchanged, budget)
    figures = {r["status"]: r["n"] for r in rows.groupBy("status").agg(F.count("*").alias("n")).collect()}
    return Report(diff.update_mode(rows) if update else rows, figures, store.warnings(*sides[0], *sides[1]), h)


def covered(store, candidate: str, keepers: list[str], min_size: int = 0, excludes=(), exclude_mode: str = "all", by_dir: bool = False, rollup: bool = False, limit: int = LISTED, detail: int = 3) -> Report:
    """Would content be lost if the candidate went and the keepers stayed?

    rows: the uncovered files in path order (or directories with by_dir, or the lines of a roll-up), `limit` at most,
    0: all.  figures: counts and bytes by status over all files, `listed`, `unlisted`, `excluded` and `loss` (something would be lost).
    exclude_mode: all (excluded files are not looked at) or uncovered (they count as files, but never as a loss).
    """
    if not keepers:
        raise ValueError("a snapshot at least to check against is needed")
    if rollup and by_dir:
        raise ValueError("a roll-up is not listed by directory")
    if exclude_mode not in ("all", "uncovered"):
        raise ValueError(f"not a mode of excluding: {exclude_mode}")
    c, held = store.resolve(candidate), [store.resolve(k) for k in keepers]
    if any(k["id"] == c["id"] for k in held):
        raise ValueError(f"the snapshot {c['name']} is checked against itself")
    warnings = store.warnings(c, *held)
    files = store.files(c)
    zero = {"n_files": 0, "n_covered": 0, "n_uncovered": 0, "n_no_hash": 0, "bytes_covered": 0, "bytes_uncovered": 0, "bytes_no_hash": 0}
    if files.isEmpty():
        return Report(None, zero | {"excluded": 0, "listed": 0, "unlisted": 0, "loss": False}, warnings, None)
    h = _agreed(None, coverage.negotiate(c, held))
    out = paths.excluded(F.col("path"), c["root_path"], excludes)
    tags = coverage.tagged(files, [store.files(k) for k in held], h, min_size).withColumn("excluded", out)
    tags = saved(tags)
    left = tags.where("not excluded" if exclude_mode == "all" else "not excluded or status = 'covered'").drop("excluded")
    figures = coverage.summary(left).first().asDict()
    figures["excluded"] = tags.where("excluded" if exclude_mode == "all" else "excluded and status <> 'covered'").count()
    figures["loss"] = figures["n_uncovered"] + figures["n_no_hash"] > 0
    if rollup:
        rows, n = coverage.report(left, detail), 0
        return Report(rows, figures | {"listed": 0, "unlisted": 0}, warnings, h)
    rows = coverage.by_dir(left).orderBy("dir") if by_dir else left.where("status = 'uncovered'").orderBy("path")
    n = rows.count() if by_dir else figures["n_uncovered"]
    listed = min(n, limit) if limit else n
    return Report(rows.limit(limit) if limit else rows, figures | {"listed": listed, "unlisted": n - listed}, warnings, h)


def duplicates(store, ref: str, min_size: int = 0, limit: int = 0) -> Report:
    """Groups of equal files and directories, the most wasteful first; figures: groups and wasted bytes of all of them."""
    s = store.resolve(ref)
    found = dupes.duplicates(store.files(s), min_size)
    return Report(dupes.wasted(found, limit), dupes.total_wasted(found).first().asDict(), store.warnings(s))


def listing(store) -> str:
    """The snapshots as a text table, the last finished first."""
    head = ["ID", "Name", "Status", "Started at", "Finished at", "Computer", "Root"]
    when = lambda t: "N/A" if t is None else f"{t:%Y-%m-%dT%H:%M:%S}"
    rows = []
    for s in store.listing().where("status <> 'deleted'").collect():
        status = s["status"] + (f" ({values.plural(s['error_count'], 'error')})" if s["error_count"] else "")
        rows.append([str(s["id"]), s["name"], status, when(s["started_at"]), when(s["finished_at"]), s["computer_name"] or "", s["root_path"] or ""])
    return values.text_table(head, rows)
