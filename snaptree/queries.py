"""Queries over the snapshots of fixtures.py, and the SQL that gives the same rows."""
from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import CATALOG, snapshot, sql
from .functions import paths, values
from .operators import basic, coverage, diff, dupes
from .sources import legacy, zfs
from .sources.store import Store
from .streaming import follow
from .tables import cleaned, saved, shared_dir

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Directory components of a path, and its proper ancestors, in DuckDB.
_PARTS = "list_filter(string_split(path, '/'), lambda x: x <> '')"
_UP = "unnest(list_transform(range(0, len(p)), lambda i: array_to_string(p[1:i], '/')))"


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({sql(n)})" for n in names)


@query(f"{_with('docs_a')} SELECT count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS n_bytes FROM docs_a")
def size_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basic.totals(snapshot(spark, sf_dir, "docs_a"))


@query(f"{_with('docs_a')} SELECT count(*) AS n_files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS n_bytes FROM docs_a WHERE size_bytes >= 2048")
def snapshot_totals_minsize(spark, sf_dir):
    return basic.totals(snapshot(spark, sf_dir, "docs_a"), 2048)


@query(f"{_with('docs_a')} SELECT bool_or(size_bytes > 0) AS has_sizes FROM docs_a")
def has_sizes(spark, sf_dir):
    return basic.has_sizes(snapshot(spark, sf_dir, "docs_a"))


@query(f"{_with('lines_f')} SELECT bool_or(sha1 IS NOT NULL) AS has_sha1, bool_or(md5 IS NOT NULL) AS has_md5 FROM lines_f")
def detect_hashes(spark, sf_dir):
    return basic.detect_hashes(snapshot(spark, sf_dir, "lines_f"))


@query(CATALOG.replace("SELECT * FROM VALUES", "SELECT id, name, status, finished_at FROM (VALUES").replace(" AS t(", ") AS t("))
def snapshot_list(spark, sf_dir):
    return basic.listing(spark.sql(CATALOG)).select("id", "name", "status", "finished_at")


def _find(name: str, oracle: str, *args, **kw):
    def run(spark, sf_dir):
        return basic.find(snapshot(spark, sf_dir, "pages_f"), *args, **kw).select("path", "size_bytes")

    run.__name__ = name
    query(f"{_with('pages_f')} SELECT path, size_bytes FROM pages_f WHERE {oracle}")(run)


_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_find("find_glob", f"regexp_matches(lower({_NAME}), '^p1[^/]*[^/]7$')", "P1*?7")
_find("find_glob_cs", f"regexp_matches({_NAME}, '^p[^/]*5$')", "p*5", case_sensitive=True)
_find("find_glob_class", f"regexp_matches({_NAME}, '^p[2-5][^/]*[^0-4]$')", "p[2-5]*[^0-4]")
_find("find_regex", f"regexp_matches({_NAME}, '(1|3)[02468]')", "(1|3)[02468]", regex=True, case_sensitive=True)


@query(f"{_with('docs_a')} SELECT path FROM docs_a WHERE NOT (path = '/mnt/a/src1' OR starts_with(path, '/mnt/a/src1/') OR path = '/mnt/a/src3/en' OR starts_with(path, '/mnt/a/src3/en/'))")
def exclude_filter(spark, sf_dir):
    return snapshot(spark, sf_dir, "docs_a").where(~paths.excluded(F.col("path"), "/mnt/a", ["/mnt/a/src1", "src3/en", " "])).select("path")


@query(f"{_with('docs_a')} SELECT path, substr(path, 8) AS rel FROM docs_a")
def relativize(spark, sf_dir):
    return snapshot(spark, sf_dir, "docs_a").select("path", paths.relative(F.col("path"), "/mnt/a").alias("rel"))


@query(f"{_with('pages_f')} SELECT path, {_NAME} AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM pages_f")
def basename_dirname(spark, sf_dir):
    p = F.col("path")
    return snapshot(spark, sf_dir, "pages_f").select("path", paths.basename(p).alias("name"), paths.dirname(p).alias("dir"))


@query(f"{_with('docs_b')} SELECT path, row_number() OVER (ORDER BY {_PARTS}) AS dfs_rank FROM docs_b")
def dfs_rank(spark, sf_dir):
    from .operators.rank import ranked

    rows = snapshot(spark, sf_dir, "docs_b").select("path", paths.parts(F.col("path")).alias("p"), F.lit(0).alias("all"))
    return ranked(rows, ["all"], ["p"], "dfs_rank").select("path", "dfs_rank")


# coverage: is what docs_a holds still in docs_b and in the archive of pages?

_TAGS = f"""{_with('docs_a', 'docs_b', 'pages_f')}, tags AS (SELECT path, size_bytes, CASE WHEN sha1 IS NULL THEN 'no_hash'
 WHEN EXISTS (SELECT 1 FROM docs_b k WHERE k.sha1 = c.sha1) OR EXISTS (SELECT 1 FROM pages_f k WHERE k.sha1 = c.sha1) THEN 'covered' ELSE 'uncovered' END AS status FROM docs_a c)"""
_BACK = f"""{_with('docs_a', 'docs_b')}, tags AS (SELECT path, size_bytes, CASE WHEN sha1 IS NULL THEN 'no_hash'
 WHEN EXISTS (SELECT 1 FROM docs_a k WHERE k.sha1 = c.sha1) THEN 'covered' ELSE 'uncovered' END AS status FROM docs_b c)"""


def _tags(spark, sf_dir, **kw):
    return coverage.tagged(snapshot(spark, sf_dir, "docs_a"), [snapshot(spark, sf_dir, "docs_b"), snapshot(spark, sf_dir, "pages_f")], root="/mnt/a", **kw)


def _back(spark, sf_dir):
    return coverage.tagged(snapshot(spark, sf_dir, "docs_b"), [snapshot(spark, sf_dir, "docs_a")], root="/mnt/b")


@query(f"{_BACK} SELECT * FROM tags")
def coverage_status(spark, sf_dir):
    return _back(spark, sf_dir)


@query(f"{_TAGS} SELECT path, size_bytes, status FROM tags WHERE status <> 'covered'")
def coverage_uncovered(spark, sf_dir):
    return coverage.uncovered(_tags(spark, sf_dir))


@query(f"{_TAGS} SELECT status, count(*) AS n FROM tags GROUP BY status")
def coverage_union_keepers(spark, sf_dir):
    return _tags(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"{_TAGS} SELECT path, status FROM tags WHERE size_bytes >= 3000")
def coverage_minsize(spark, sf_dir):
    return _tags(spark, sf_dir, min_size=3000).select("path", "status")


_SUM = ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}, CAST(coalesce(sum(size_bytes) FILTER (status = '{s}'), 0) AS BIGINT) AS bytes_{s}" for s in ("covered", "uncovered", "no_hash"))


@query(f"{_BACK} SELECT count(*) AS n_files, {_SUM} FROM tags")
def coverage_summary(spark, sf_dir):
    return coverage.summary(_back(spark, sf_dir))


@query(f"{_TAGS} SELECT count(*) AS n_files, {_SUM} FROM tags WHERE NOT starts_with(path, '/mnt/a/src2/')")
def coverage_exclude(spark, sf_dir):
    return coverage.summary(_tags(spark, sf_dir, excludes=["src2"]))


@query(f"{_TAGS} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS n_bytes FROM tags WHERE status <> 'covered' GROUP BY ALL")
def coverage_by_dir(spark, sf_dir):
    return coverage.by_dir(_tags(spark, sf_dir))


_ROLL = f"""{_TAGS}, up AS (SELECT status, {_UP} AS dir FROM (SELECT status, {_PARTS} AS p FROM tags)),
roll AS (SELECT dir, CAST(CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END AS BIGINT) AS depth, count(*) FILTER (status = 'covered') AS n_covered, count(*) FILTER (status = 'uncovered') AS n_uncovered,
 count(*) FILTER (status = 'no_hash') AS n_no_hash FROM up GROUP BY dir)"""
_VERDICT = "CASE WHEN n_uncovered + n_no_hash = 0 THEN 'covered' WHEN n_covered = 0 THEN 'not_covered' ELSE 'mixed' END"


@query(f"{_ROLL} SELECT dir, depth, n_covered, n_uncovered, n_no_hash FROM roll")
def coverage_rollup_counts(spark, sf_dir):
    return coverage.rollup(_tags(spark, sf_dir)).drop("verdict")


@query(f"{_ROLL} SELECT dir, {_VERDICT} AS verdict FROM roll")
def coverage_rollup_verdict(spark, sf_dir):
    return coverage.rollup(_tags(spark, sf_dir)).select("dir", "verdict")


@query(f"""{_ROLL}, v AS (SELECT dir, {_VERDICT} AS verdict, n_uncovered + n_no_hash AS bad FROM roll),
above AS (SELECT dir, {_UP} AS up FROM (SELECT dir, string_split(dir, '/') AS p FROM v WHERE dir <> '')),
shown AS (SELECT * FROM v WHERE dir NOT IN (SELECT a.dir FROM above a JOIN v u ON a.up = u.dir WHERE u.verdict <> 'mixed' OR u.bad <= 3)),
bad AS (SELECT array_to_string({_PARTS}, '/') AS path, status FROM tags WHERE status <> 'covered'),
fa AS (SELECT path, status, {_UP} AS up FROM (SELECT path, status, string_split(path, '/') AS p FROM bad)),
ln AS (SELECT dir AS path, CASE WHEN verdict <> 'mixed' THEN verdict WHEN bad <= 3 THEN 'listed' ELSE 'summary' END AS kind, bad AS n_bad FROM shown)
SELECT path, kind, n_bad FROM ln UNION ALL SELECT fa.path, status, 1 FROM fa JOIN ln ON fa.up = ln.path WHERE kind = 'listed'
UNION ALL SELECT fa.path, status, 1 FROM fa JOIN ln ON fa.up = ln.path WHERE kind = 'summary' AND regexp_extract(fa.path, '^(.*)/[^/]*$', 1) = ln.path""")
def coverage_rollup_lines(spark, sf_dir):
    return coverage.rollup_lines(_tags(spark, sf_dir))


_NODES = f"""f AS (SELECT array_to_string({_PARTS}, '/') AS path, {_PARTS} AS p, coalesce(sha1, md5) AS h, size_bytes FROM docs_b),
u AS (SELECT path, h, size_bytes, {_UP} AS up FROM f),
nodes AS (SELECT path, false AS is_dir, 'f' || h AS key, size_bytes, CAST(1 AS BIGINT) AS n_files FROM f UNION ALL
 SELECT up, true, 'd' || md5(string_agg(CASE WHEN up = '' THEN path ELSE substr(path, length(up) + 2) END || '|' || h, '//' ORDER BY path) FILTER (h IS NOT NULL)), CAST(sum(size_bytes) AS BIGINT), count(*) FROM u GROUP BY up),
g AS (SELECT key, count(*) AS n_members, min(path) AS group_path FROM nodes WHERE key IS NOT NULL GROUP BY key HAVING count(*) >= 2 AND max(size_bytes) >= 1),
m AS (SELECT n.*, n_members, group_path FROM nodes n JOIN g USING (key)),
x AS (SELECT key, path, is_dir, {_UP} AS up FROM (SELECT key, path, is_dir, string_split(path, '/') AS p FROM m WHERE path <> '')),
c AS (SELECT DISTINCT key, path, is_dir FROM x WHERE up IN (SELECT path FROM m WHERE is_dir)),
d AS (SELECT group_path, path, is_dir, size_bytes, n_files, n_members FROM m WHERE key IN (SELECT key FROM m ANTI JOIN c USING (key, path, is_dir)))"""


@query(f"{_with('docs_b')}, {_NODES} SELECT * FROM d WHERE NOT is_dir")
def dupes_files(spark, sf_dir):
    return dupes.duplicates(snapshot(spark, sf_dir, "docs_b"), 1).where("not is_dir")


@query(f"{_with('docs_b')}, {_NODES} SELECT * FROM d")
def dupes_highest(spark, sf_dir):
    return dupes.duplicates(snapshot(spark, sf_dir, "docs_b"), 1)


@query(f"{_with('docs_b')}, {_NODES} SELECT group_path, is_dir, n_members, (n_members - 1) * max(size_bytes) AS wasted_bytes FROM d GROUP BY group_path, is_dir, n_members ORDER BY wasted_bytes DESC, group_path, is_dir LIMIT 10")
def dupes_wasted_topk(spark, sf_dir):
    return dupes.wasted(dupes.duplicates(snapshot(spark, sf_dir, "docs_b"), 1), 10)


@query(f"{_with('lines_f')} SELECT path, arg_max(sha1, seq) AS sha1, max(seq) AS seq FROM lines_f GROUP BY path")
def upsert_latest(spark, sf_dir):
    return basic.latest(snapshot(spark, sf_dir, "lines_f").drop("md5", "size_bytes"), ("path",), ("seq",))


_INPUTS = f"""{_with('docs_a', 'docs_b', 'pages_f')}, i AS (SELECT substr(path, 8) AS path, size_bytes, sha1, md5, CAST(0 AS BIGINT) AS input FROM docs_a UNION ALL SELECT substr(path, 8), size_bytes, sha1, md5, 1 FROM docs_b
 UNION ALL SELECT path, size_bytes, sha1, md5, 2 FROM pages_f),
l AS (SELECT *, coalesce(sha1, md5, '') AS h, lag(coalesce(sha1, md5, '')) OVER w AS had, row_number() OVER w AS k FROM i WINDOW w AS (PARTITION BY path ORDER BY input))"""


def _inputs(spark, sf_dir):
    one = lambda n, root: basic.relativised(snapshot(spark, sf_dir, n), root)
    return [one("docs_a", "/mnt/a"), one("docs_b", "/mnt/b"), snapshot(spark, sf_dir, "pages_f")]


@query(f"{_INPUTS} SELECT path, arg_max(size_bytes, input) AS size_bytes, arg_max_null(sha1, input) AS sha1, arg_max_null(md5, input) AS md5, max(input) AS input FROM i GROUP BY path")
def merge_last_wins(spark, sf_dir):
    return basic.merge(_inputs(spark, sf_dir))


@query(f"{_INPUTS} SELECT path, input, had, h AS has FROM l WHERE had <> h")
def merge_conflicts(spark, sf_dir):
    return basic.conflicts(_inputs(spark, sf_dir))


@query(f"{_INPUTS} SELECT count(*) AS n_records, count(*) FILTER (k = 1) AS n_unique, count(*) FILTER (k > 1) AS n_collapsed, count(*) FILTER (had <> h) AS n_conflicts FROM l")
def merge_counters(spark, sf_dir):
    return basic.merge_counters(_inputs(spark, sf_dir))


# diff of docs_a and docs_b

def _paired(a: str, b: str, skip_a: int, skip_b: int) -> str:
    """The files of two snapshots paired by relative path (what comes before is skipped), and their directories, in SQL."""
    return f"""{_with(a, b)}, a AS (SELECT substr(path, {skip_a}) AS path, sha1, size_bytes FROM {a}), b AS (SELECT substr(path, {skip_b}) AS path, sha1, size_bytes FROM {b}),
pair AS (SELECT coalesce(a.path, b.path) AS path, a.path IS NOT NULL AS in_a, b.path IS NOT NULL AS in_b, a.sha1 AS ha, b.sha1 AS hb, a.size_bytes AS sa, b.size_bytes AS sb,
 CASE WHEN b.path IS NULL THEN 'Removed' WHEN a.path IS NULL THEN 'Added' WHEN a.sha1 = b.sha1 THEN 'Unchanged' ELSE 'Modified' END AS status FROM a FULL JOIN b ON a.path = b.path),
pu AS (SELECT *, {_UP} AS up FROM (SELECT *, string_split(path, '/') AS p FROM pair))"""


_PAIR = _paired("docs_a", "docs_b", 8, 8)


def _sides(spark, sf_dir):
    return basic.relativised(snapshot(spark, sf_dir, "docs_a"), "/mnt/a"), basic.relativised(snapshot(spark, sf_dir, "docs_b"), "/mnt/b")


@query(f"{_PAIR} SELECT path, in_a, in_b, status FROM pair")
def diff_pair_status(spark, sf_dir):
    return diff.pair(*_sides(spark, sf_dir)).select("path", "in_a", "in_b", "status")


@query(f"{_PAIR} SELECT up AS path, bool_or(in_a) AS in_a, bool_or(in_b) AS in_b FROM pu GROUP BY up")
def diff_presence_dirs(spark, sf_dir):
    return diff.directories(diff.with_twins(diff.pair(*_sides(spark, sf_dir)))).select("path", "in_a", "in_b")


@query(f"{_PAIR} SELECT up AS path, count(*) FILTER (in_a) AS n_a, count(*) FILTER (in_b) AS n_b FROM pu GROUP BY up")
def diff_dir_counts(spark, sf_dir):
    return diff.directories(diff.with_twins(diff.pair(*_sides(spark, sf_dir)))).select("path", "n_a", "n_b")


@query(f"{_PAIR} SELECT path, status FROM pair WHERE path IN (SELECT up FROM pu)")
def diff_twins(spark, sf_dir):
    return diff.with_twins(diff.pair(*_sides(spark, sf_dir))).where("is_twin").select("path", "status")


def _matching(moves: bool, copies: bool) -> str:
    """The matching of files, directories left out, in SQL: each role's sources are numbered and used once."""
    first = "r.rank <= coalesce(n_r, 0)" if moves else "false"
    j = "(r.rank - coalesce(n_r, 0))" if moves else "r.rank"
    take = f"CASE WHEN {first} THEN 'R' WHEN {j} <= coalesce(n_m, 0) THEN 'M' ELSE 'E' END" if copies else f"CASE WHEN {first} THEN 'R' END"
    at = f"CASE WHEN {first} THEN r.rank WHEN {j} <= coalesce(n_m, 0) THEN {j} ELSE {j} - coalesce(n_m, 0) END"
    status = f"CASE WHEN {first} THEN 'Move' WHEN {j} <= coalesce(n_m, 0) AND r.status = 'Modified' AND {moves} THEN 'Move' ELSE 'Copy' END"
    copied = f"""SELECT r.path, {status} AS status, s.path AS source FROM r LEFT JOIN n ON n.key = r.key JOIN s ON s.key = r.key AND s.role = {take} AND s.rank = {at}"""
    if not copies:
        copied += f""" UNION ALL SELECT x.path, 'Move', s.path FROM (SELECT r.*, row_number() OVER (PARTITION BY r.key ORDER BY ord) AS k FROM r LEFT JOIN n ON n.key = r.key WHERE NOT {first} AND r.status = 'Modified') x
 JOIN s ON s.key = x.key AND s.role = 'M' AND s.rank = x.k"""
    return f"""{_PAIR}, src AS (SELECT path, ha AS key, string_split(path, '/') AS ord, status FROM pair WHERE in_a AND ha IS NOT NULL AND sa > 0),
s AS (SELECT *, row_number() OVER (PARTITION BY key, role ORDER BY ord) AS rank FROM (SELECT *, 'E' AS role FROM src UNION ALL SELECT *, 'R' FROM src WHERE status = 'Removed' UNION ALL SELECT *, 'M' FROM src WHERE status = 'Modified')),
n AS (SELECT key, count(*) FILTER (role = 'R') AS n_r, count(*) FILTER (role = 'M') AS n_m FROM s GROUP BY key),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS rank FROM (SELECT path, hb AS key, string_split(path, '/') AS ord, status FROM pair WHERE status IN ('Added', 'Modified') AND hb IS NOT NULL AND sb > 0))
{copied}"""


@cleaned
def _matched(spark, sf_dir, moves=True, copies=True):
    files = saved(diff.with_twins(diff.pair(*_sides(spark, sf_dir))))
    dirs = saved(diff.directories(files))
    status = diff.rolled(files.withColumn("source", F.lit(None).cast("string")), dirs)
    found = diff.match(files, dirs.join(status.select("path", "status"), "path"), moves, copies)
    return found.where("not is_dir").select("path", "status", F.ltrim("source", F.lit("/")).alias("source"))


@query(_matching(True, True))
def diff_match_moves(spark, sf_dir):
    return _matched(spark, sf_dir)


@query(_matching(False, True))
def diff_match_nomoves(spark, sf_dir):
    return _matched(spark, sf_dir, moves=False)


@query(_matching(True, False))
def diff_match_nocopies(spark, sf_dir):
    return _matched(spark, sf_dir, copies=False)


def _diff(spark, sf_dir, **kw):
    return diff.diff(*_sides(spark, sf_dir), "/mnt/a", "/mnt/b", **kw)


@query()
def diff_lines(spark, sf_dir):
    return _diff(spark, sf_dir)


@query()
def diff_lines_budget(spark, sf_dir):
    return _diff(spark, sf_dir, budget=3)


@query()
def diff_show_unchanged(spark, sf_dir):
    return _diff(spark, sf_dir, show_unchanged=True)


@query()
def diff_update_mode(spark, sf_dir):
    return diff.update_mode(_diff(spark, sf_dir))


def _levels(depth: int = 3, pair: str = _PAIR) -> str:
    """The roll-up without moves and copies of directories down to the given depth, level by level, in SQL."""
    out = [
        pair, "fs AS (SELECT path, string_split(path, '/') AS p, status, path IN (SELECT up FROM pu) AS is_twin FROM pair)",
        "ds AS (SELECT up AS path, bool_or(in_a) AS in_a, CASE WHEN up = '' THEN 0 ELSE len(string_split(up, '/')) END AS depth FROM pu GROUP BY up)",
        "fp AS (SELECT *, array_to_string(p[1:len(p) - 1], '/') AS parent, len(p) AS depth FROM fs)",
    ]
    for k in range(depth, -1, -1):
        below = f" UNION ALL SELECT array_to_string(string_split(path, '/')[1:{k}], '/'), status, has_unch FROM n{k + 1}" if k < depth else ""
        out.append(f"""c{k} AS (SELECT parent AS path, status, status = 'Unchanged' AS has_unch FROM fp WHERE depth = {k + 1} AND NOT is_twin{below}),
g{k} AS (SELECT path, bool_and(status = 'Unchanged') AS all_u, bool_and(status = 'Removed') AS all_r, bool_and(status = 'Added') AS all_a, bool_or(status = 'Modified') AS some_m, bool_or(status = 'Added') AS some_a,
 bool_or(has_unch) AS unch, count(*) FILTER (status IN ('Added', 'Removed', 'Modified')) AS n FROM c{k} GROUP BY path),
o{k} AS (SELECT d.path, t.status AS twin, coalesce(unch, false) AS unch, CASE WHEN coalesce(all_u, true) THEN 'Unchanged' WHEN all_r THEN 'Removed' WHEN NOT in_a AND all_a THEN 'Added' WHEN unch OR NOT (all_a OR n >= 2) THEN 'Mixed'
 WHEN some_m THEN 'Modified' WHEN all_a AND some_a THEN 'Added' WHEN NOT in_a THEN 'Added' ELSE 'Modified' END AS status FROM ds d LEFT JOIN g{k} USING (path) LEFT JOIN fs t ON t.is_twin AND t.path = d.path WHERE d.depth = {k}),
n{k} AS (SELECT path, CASE WHEN twin IS NULL OR twin = 'Unchanged' OR twin = status THEN status ELSE 'Mixed' END AS status, coalesce(twin = 'Unchanged', false) OR CASE status WHEN 'Unchanged' THEN true WHEN 'Mixed' THEN unch ELSE false END AS has_unch FROM o{k})""")
    every = " UNION ALL ".join(f"SELECT path, status FROM n{k}" for k in range(depth + 1))
    return ",\n".join([*out, f"dirs AS ({every})"])


@query(f"{_levels()} SELECT path, status FROM dirs")
def diff_rollup(spark, sf_dir):
    """Status of each directory without moves and copies."""
    return diff.solve(*_sides(spark, sf_dir), moves=False, copies=False)[1].select("path", "status")


_COUNT = {"Added": "added_count", "Removed": "removed_count", "Modified": "modified_count", "Copy": "copy_count", "Move": "move_count"}


def _plain_lines(shown: bool = False, budget: int = 0, only: str = "true", depth: int = 3, pair: str = _PAIR, roots: tuple[str, str] = ("/mnt/a", "/mnt/b")) -> str:
    """The lines of a diff without moves and copies in SQL: what no summary above hides, its counts, the budget, the order."""
    zero = "CAST(0 AS BIGINT)"
    step = lambda x: f"list_transform({x}, lambda y: {{'k': 0, 'n': y, 't': 0}})"
    sums = ", ".join(f"count(*) FILTER (status = '{s}') AS {c}" for s, c in _COUNT.items())
    own = ", ".join(f"CASE WHEN is_dir THEN coalesce(k.{c}, 0) WHEN t.status = '{s}' THEN 1 ELSE 0 END AS {c}" for s, c in _COUNT.items())
    extra = [f"CASE WHEN is_dir THEN coalesce({x}, 0) ELSE 0 END" if shown else "0" for x in ("k.n_files", "kd.n_dirs")]
    steps = [
        _levels(depth, pair), "nodes AS (SELECT path, p, false AS is_dir, is_twin, status FROM fs UNION ALL SELECT path, string_split(path, '/'), true, false, status FROM dirs WHERE path <> '')",
        f"hid AS (SELECT DISTINCT path, is_dir, is_twin FROM (SELECT path, is_dir, is_twin, {_UP} AS up FROM nodes) WHERE up IN (SELECT path FROM dirs WHERE path <> '' AND status <> 'Mixed'))",
        "told AS (SELECT * FROM nodes ANTI JOIN hid USING (path, is_dir, is_twin) WHERE status IN ('Added', 'Removed', 'Modified') OR is_dir AND status = 'Mixed')",
        f"fu AS (SELECT status, unnest(list_transform(range(0, len(p) + CAST(is_twin AS INT)), lambda i: array_to_string(p[1:i], '/'))) AS path FROM fs)",
        f"k AS (SELECT path, {sums}, count(*) FILTER (status = 'Unchanged') AS n_files FROM fu GROUP BY path)",
        "du AS (SELECT unnest(CASE WHEN path = '' THEN [''] ELSE list_transform(range(0, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/')) END) AS path FROM dirs WHERE status = 'Unchanged')",
        "kd AS (SELECT path, count(*) AS n_dirs FROM du GROUP BY path)",
        f"""b0 AS (SELECT t.path || CASE WHEN is_dir THEN '/' ELSE '' END AS path, t.status, {own}, {extra[0]} AS unchanged_file_count, {extra[1]} AS unchanged_dir_count, {zero} AS hidden_count,
 list_transform(p, lambda y, i: {{'k': 0, 'n': y, 't': CASE WHEN i < len(p) OR NOT is_twin THEN 0 WHEN t.status = 'Removed' THEN -1 ELSE 1 END}}) AS key, p[1:len(p) - 1] AS owner
 FROM told t LEFT JOIN k ON k.path = t.path LEFT JOIN kd ON kd.path = t.path WHERE t.status <> 'Mixed'""",
    ]
    if shown:
        none = ", ".join(f"{zero} AS {c}" for c in _COUNT.values())
        steps[-1] += f""" UNION ALL SELECT CASE WHEN m.path = '' THEN '.' ELSE m.path || '/' END, 'Mixed', {none}, coalesce(n_files, 0), coalesce(n_dirs, 0), {zero}, list_concat({step('p')}, [{{'k': 2, 'n': '', 't': 0}}]), CASE WHEN len(p) > 0 THEN p[1:len(p) - 1] ELSE p END
 FROM (SELECT path, p FROM told WHERE status = 'Mixed' UNION ALL SELECT '', CAST([] AS VARCHAR[])) m LEFT JOIN k ON k.path = m.path LEFT JOIN kd ON kd.path = m.path WHERE coalesce(n_files, 0) + coalesce(n_dirs, 0) > 0"""
    steps[-1] += ")"
    last = "b0"
    counts = [*_COUNT.values(), "unchanged_file_count", "unchanged_dir_count"]
    for at in range(depth, 0, -1) if budget else ():
        kept = ", ".join(["path", "status", *counts, "hidden_count", "key", "owner"])
        sums = ", ".join(f"sum({c})" for c in counts)
        steps += [
            f"r{at} AS (SELECT *, owner[1:{at}] AS dir, row_number() OVER (PARTITION BY owner[1:{at}] ORDER BY key) AS n FROM {last} WHERE len(owner) >= {at})",
            f"""b{at} AS (SELECT {kept} FROM {last} WHERE len(owner) < {at} UNION ALL SELECT {kept} FROM r{at} WHERE n <= {budget} UNION ALL
 SELECT array_to_string(dir, '/') || '/', 'Truncated', {sums}, sum(hidden_count) + count(*), list_concat({step('dir')}, [{{'k': 1, 'n': '', 't': 0}}]), dir[1:{at - 1}] FROM r{at} WHERE n > {budget} GROUP BY dir)""",
        ]
        last = f"b{at}"
    whole = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in [*counts, "hidden_count"])
    text = "CAST(NULL AS VARCHAR)"
    return f"""{", ".join(steps)}, z AS (SELECT *, CASE WHEN status IN ('Removed', 'Modified') THEN '{roots[0]}' ELSE '{roots[1]}' END AS root, row_number() OVER (ORDER BY key) AS line_no FROM {last})
SELECT CASE WHEN path = '.' THEN root ELSE root || '/' || path END AS path, root, path AS rel_path, status, {text} AS source_path, {text} AS source_root, {text} AS source_rel_path, {whole}, line_no FROM z WHERE {only}"""


def _plain(spark, sf_dir, **kw):
    return _diff(spark, sf_dir, moves=False, copies=False, **kw)


@query(_plain_lines())
def diff_plain_lines(spark, sf_dir):
    """The diff without moves and copies: as removed and added."""
    return _plain(spark, sf_dir)


@query(_plain_lines(budget=3))
def diff_plain_budget(spark, sf_dir):
    return _plain(spark, sf_dir, budget=3)


@query(_plain_lines(shown=True))
def diff_plain_unchanged(spark, sf_dir):
    return _plain(spark, sf_dir, show_unchanged=True)


@query(_plain_lines(shown=True, budget=2, only="status IN ('Removed', 'Modified', 'Truncated', 'Mixed')"))
def diff_plain_update(spark, sf_dir):
    return diff.update_mode(_plain(spark, sf_dir, show_unchanged=True, budget=2))


@query(f"""{_with('orders_a', 'orders_b', 'pages_f')}, a AS (SELECT substr(path, 14) AS path, sha1 FROM orders_a UNION ALL SELECT replace(substr(path, 6), '//', '/'), sha1 FROM pages_f), b AS (SELECT substr(path, 12) AS path, sha1 FROM orders_b)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'Removed' WHEN a.path IS NULL THEN 'Added' WHEN a.sha1 = b.sha1 THEN 'Unchanged' ELSE 'Modified' END AS status FROM a FULL JOIN b ON a.path = b.path""")
def diff_multi_source(spark, sf_dir):
    a = basic.combined([(snapshot(spark, sf_dir, "orders_a"), "/tank/orders"), (snapshot(spark, sf_dir, "pages_f"), "/web")])
    return diff.pair(a, basic.relativised(snapshot(spark, sf_dir, "orders_b"), "/tank/copy")).select("path", "status")


# no content is found at another path here, so moves and copies change nothing
@query(_plain_lines(pair=_paired("orders_a", "orders_b", 14, 12), roots=("/tank/orders", "/tank/copy")))
def diff_orders(spark, sf_dir):
    """The diff of two large snapshots."""
    return diff.diff(basic.relativised(snapshot(spark, sf_dir, "orders_a"), "/tank/orders"), basic.relativised(snapshot(spark, sf_dir, "orders_b"), "/tank/copy"), "/tank/orders", "/tank/copy")


@query(f"{_with('orders_a', 'orders_b')} SELECT CASE WHEN EXISTS (SELECT 1 FROM orders_b k WHERE k.sha1 = c.sha1) THEN 'covered' ELSE 'uncovered' END AS status, count(*) AS n FROM orders_a c GROUP BY 1")
def coverage_orders(spark, sf_dir):
    tags = coverage.tagged(snapshot(spark, sf_dir, "orders_a"), [snapshot(spark, sf_dir, "orders_b")])
    return tags.groupBy("status").agg(F.count("*").alias("n"))


@query(f"{_with('docs_a')} SELECT coalesce(md5, '-') || '  utf-8  ' || to_base64(encode(path)) AS hash_line, size_bytes || '  utf-8  ' || to_base64(encode(path)) AS size_line FROM docs_a")
def legacy_export(spark, sf_dir):
    return legacy.lines(snapshot(spark, sf_dir, "docs_a"))


@query(f"{_with('docs_a')} SELECT path, size_bytes, md5 FROM docs_a")
def legacy_import_roundtrip(spark, sf_dir):
    x = legacy.lines(snapshot(spark, sf_dir, "docs_a"))
    return legacy.parse(x.select(F.col("hash_line").alias("value")), x.select(F.col("size_line").alias("value"))).select("path", "size_bytes", "md5")


@query("""
SELECT name, CASE WHEN name = 'tank/skip' OR starts_with(name, 'tank/skip/') THEN 'excluded' WHEN type = 'volume' THEN 'volume' WHEN canmount = 'off' THEN 'canmount_off' WHEN seen = 'completed' THEN 'already_done' WHEN seen = 'failed' THEN 'failed' WHEN seen = 'in_progress' THEN 'resume' ELSE 'scan' END AS plan
FROM (VALUES ('tank', 'on', 'filesystem', 'completed'), ('tank/a', 'on', 'filesystem', NULL), ('tank/off', 'off', 'filesystem', NULL), ('tank/skip', 'on', 'filesystem', NULL), ('tank/skip/x', 'on', 'filesystem', NULL),
 ('tank/skipped', 'on', 'filesystem', 'failed'), ('tank/vol', 'on', 'volume', NULL), ('tank/wip', 'on', 'filesystem', 'in_progress')) AS t(name, canmount, type, seen)""")
def zfs_plan(spark, sf_dir):
    rows = [("tank", "on", "filesystem"), ("tank/a", "on", "filesystem"), ("tank/off", "off", "filesystem"), ("tank/skip", "on", "filesystem"), ("tank/skip/x", "on", "filesystem"), ("tank/skipped", "on", "filesystem"), ("tank/vol", "on", "volume"), ("tank/wip", "on", "filesystem")]
    text = spark.createDataFrame([(f"{n}\t/{n}\tyes\t{c}\t{t}\t1024",) for n, c, t in rows], "value string")
    seen = spark.createDataFrame([(1, "tank", "failed"), (2, "tank", "completed"), (3, "tank/skipped", "failed"), (4, "tank/wip", "in_progress")], "id long, name string, status string")
    return zfs.plan(zfs.parse(text), seen, ["tank/skip"]).select("name", "plan")


# the store: snapshots are written to a new store in the shared folder and read back


def _store(spark) -> Store:
    return Store(spark, f"{shared_dir(spark)}/store")


def _kept(store: Store, name: str, files: DataFrame, root: str, errors: int = 0) -> dict:
    s = store.create(name, root)
    store.write(s, files)
    return store.finish(s, errors)


_ROW = "path, regexp_extract(path, '([^/]*)$', 1) AS filename, size_bytes, sha1, md5"


@query(f"{_with('docs_a')} SELECT {_ROW} FROM docs_a WHERE size_bytes <= 2000 OR NOT starts_with(path, '/mnt/a/src1/') UNION ALL SELECT path, regexp_extract(path, '([^/]*)$', 1), size_bytes + 1, NULL, md5 FROM docs_a WHERE size_bytes > 2000 AND starts_with(path, '/mnt/a/src1/')")
def store_insert(spark, sf_dir):
    """A snapshot that is written twice, the second time with changed records of some paths."""
    store, files = _store(spark), snapshot(spark, sf_dir, "docs_a")
    s = store.create("a", "/mnt/a")
    store.write(s, files)
    again = files.where("size_bytes > 2000 and startswith(path, '/mnt/a/src1/')").withColumns({"size_bytes": F.col("size_bytes") + 1, "sha1": F.lit(None).cast("string")})
    store.write(s, again)
    return store.files(store.finish(s)).select("path", "filename", "size_bytes", "sha1", "md5")


@query(f"""{_with('docs_a', 'pages_f')} SELECT * FROM (VALUES ('by id', 'a_superseded_1', 'completed', 0), ('by name', 'pages', 'failed', 2), ('last of root', 'a', 'completed', 0), ('listed', 'a', 'completed', 0), ('listed', 'a_superseded_1', 'completed', 0), ('listed', 'pages', 'failed', 2)) AS t(how, name, status, error_count)
WHERE (SELECT count(*) FROM docs_a) > 0 AND (SELECT count(*) FROM pages_f) > 0""")
def store_lookup(spark, sf_dir):
    """Snapshots that are found by number, name and root after one was renamed and one deleted."""
    store, files = _store(spark), snapshot(spark, sf_dir, "docs_a")
    store.supersede(_kept(store, "a", files, "/mnt/a"))
    _kept(store, "pages", snapshot(spark, sf_dir, "pages_f"), "/web", errors=2)
    _kept(store, "a", files.where("size_bytes > 0"), "/mnt/a")
    store.delete(_kept(store, "gone", files.limit(1), "/mnt/a"))
    found = [("by id", store.resolve("1")), ("by name", store.resolve("pages")), ("last of root", store.last_of_root("/mnt/a"))]
    found += [("listed", r.asDict()) for r in store.listing().where("status <> 'deleted'").collect()]
    return spark.createDataFrame([(how, r["name"], r["status"], r["error_count"]) for how, r in found], "how string, name string, status string, error_count int")


@query(f"{_with('docs_a', 'docs_b')}, x AS (SELECT '/mnt/a/' || substr(path, 8) AS path, size_bytes, sha1, 0 AS k FROM docs_a UNION ALL SELECT '/mnt/a/' || substr(path, 8), size_bytes, sha1, 1 FROM docs_b WHERE NOT contains(path, '/both_')) SELECT path, arg_max(size_bytes, k) AS size_bytes, arg_max_null(sha1, k) AS sha1 FROM x GROUP BY path")
def store_merge(spark, sf_dir):
    """Two snapshots of one root merged in a store, and copied to another one."""
    store, other = _store(spark), _store(spark)
    b = basic.relativised(snapshot(spark, sf_dir, "docs_b").where("not contains(path, '/both_')"), "/mnt/b").withColumn("path", F.concat(F.lit("/mnt/a/"), "path"))
    _kept(store, "a", snapshot(spark, sf_dir, "docs_a"), "/mnt/a")
    _kept(store, "b", b, "/mnt/a")
    store.merge(["a", "b"], "both")
    return other.files(other.copy_from(store, "both")).select("path", "size_bytes", "sha1")


@query(f"{_with('pages_f')} SELECT path, size_bytes, sha1 FROM pages_f WHERE size_bytes < 4000 UNION ALL SELECT path, 0, sha1 FROM pages_f WHERE size_bytes >= 4000")
def store_stream(spark, sf_dir):
    """A snapshot that follows a folder of listings: two rounds, in the second of which some paths come again."""
    store, files, place = _store(spark), snapshot(spark, sf_dir, "pages_f").select("path", "size_bytes", "sha1", "md5"), shared_dir(spark)
    s = store.create("pages", "/web")
    for rows in (files, files.where("size_bytes >= 4000").withColumn("size_bytes", F.lit(0).cast("bigint"))):
        rows.write.mode("append").parquet(f"{place}/in")
        follow(spark, f"{place}/in", store, s, f"{place}/checkpoint").awaitTermination()
    return store.files(store.finish(s)).select("path", "size_bytes", "sha1")


@query(f"{_PAIR} SELECT DISTINCT path FROM pair WHERE path IN (SELECT up FROM pu)")
def path_clashes(spark, sf_dir):
    """Paths that are a file and a directory if two snapshots are taken as one."""
    a, b = _sides(spark, sf_dir)
    return basic.clashes(a.select("path").unionByName(b.select("path")))


@query(f"{_with('docs_a', 'docs_b')} SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'Removed' WHEN a.path IS NULL THEN 'Added' WHEN a.md5 = b.md5 THEN 'Unchanged' ELSE 'Modified' END AS status FROM (SELECT substr(path, 8) AS path, md5 FROM docs_a) a FULL JOIN (SELECT substr(path, 8) AS path, md5 FROM docs_b) b ON a.path = b.path")
def diff_pair_md5(spark, sf_dir):
    return diff.pair(*_sides(spark, sf_dir), hash_type="md5").select("path", "status")


@query(f"{_with('docs_a')} SELECT path, sha1 AS key FROM docs_a WHERE sha1 IS NOT NULL")
def hash_keys(spark, sf_dir):
    """Hashes as bytes and back."""
    rows = snapshot(spark, sf_dir, "docs_a").where("sha1 is not null")
    return rows.select("path", F.lower(F.hex(values.hash_bytes(F.col("sha1")))).alias("key"))


@query(f"{_with('docs_b')}, {_NODES} SELECT count(*) AS n_groups, CAST(coalesce(sum(w), 0) AS BIGINT) AS wasted_bytes FROM (SELECT (n_members - 1) * max(size_bytes) AS w FROM d GROUP BY group_path, is_dir, n_members)")
def dupes_total_wasted(spark, sf_dir):
    return dupes.total_wasted(dupes.duplicates(snapshot(spark, sf_dir, "docs_b"), 1))


@query(f"""{_ROLL}, v AS (SELECT dir, {_VERDICT} AS verdict, n_covered, n_uncovered + n_no_hash AS bad FROM roll),
above AS (SELECT dir, {_UP} AS up FROM (SELECT dir, string_split(dir, '/') AS p FROM v WHERE dir <> '')),
shown AS (SELECT * FROM v WHERE dir NOT IN (SELECT a.dir FROM above a JOIN v u ON a.up = u.dir WHERE u.verdict <> 'mixed' OR u.bad <= 3)),
pd AS (SELECT *, CASE WHEN dir <> '' THEN regexp_extract(dir, '^(.*)/[^/]*$', 1) END AS parent FROM shown)
SELECT c.parent AS path, count(*) AS n_dirs, CAST(sum(c.n_covered) AS BIGINT) AS n_covered FROM pd c JOIN shown p ON p.dir = c.parent WHERE c.verdict = 'covered' AND p.verdict = 'mixed' AND p.bad > 3 GROUP BY c.parent""")
def coverage_report_folded(spark, sf_dir):
    """Wholly covered directories that a report folds into one line each."""
    return coverage.report(_tags(spark, sf_dir)).where("kind = 'folded'").select("path", "n_dirs", "n_covered")


#: Queries that bench.py runs.
HEADLINE = ("coverage_orders", "coverage_status", "coverage_rollup_lines", "dupes_highest", "merge_last_wins", "diff_pair_status", "upsert_latest", "diff_lines", "diff_orders")
