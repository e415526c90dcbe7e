"""URL rules by a sort-merge range join on reversed-host keys.

A host's labels are reversed and each is closed by a dot (`www.example.com` becomes
`com.example.www.`), so a host and all its subdomains are one interval of keys.  Pages
and rules are dealt into ranges of keys; a rule goes to each range that its interval
meets.  Each task sweeps its sorted rows once, with a stack of the nested rules that
are active.  Ranges are cut by (key, salt), so a host with a third of all pages is
spread over many tasks.
"""
from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages in each range, about; keys looked at for each cut, and in all: they only place the work.
PAGES_PER_RANGE, KEYS_PER_CUT, KEYS = 200_000, 40, 200_000


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url):
    """Host and path: after the first `://` up to `/ ? #` or end (A-Z lower-cased); then up to `? #` or end."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    host = F.translate(raw, UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def reversed_host(host):
    """`www.example.com` as `com.example.www.`."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _sweep(batches):
    """One pass over rows sorted by key, rules first; a stack entry is (key, rules of that host)."""
    stack: list = []
    for batch in batches:
        c = batch.to_pydict()
        out = {"page_id": [], "url": [], "host": [], "path": [], "rule": [], "verdict": []}
        for key, is_page, pid, url, host, path, verdict in zip(c["key"], c["is_page"], c["page_id"], c["url"], c["host"], c["path"], c["verdict"], strict=True):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_page:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, set()))
                # of equal rules the one that blocks counts
                have = stack[-1][1].get(path)
                stack[-1][1][path] = (host + path, "block" if "block" in (verdict, have and have[1]) else verdict)
                stack[-1][2].add(len(path))
                continue
            best = (None, None)
            for _, rules, lengths in stack:  # outer hosts first, so of two that are equally long the inner host counts
                for n in lengths:
                    hit = rules.get(path[:n]) if n <= len(path) else None
                    if hit and (best[0] is None or len(hit[0]) >= len(best[0])):
                        best = hit
            for name, v in zip(out, (pid, url, host, path, *best), strict=True):
                out[name].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=OUT)


OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", pages_per_range: int = PAGES_PER_RANGE) -> DataFrame:
    """page_id, url, host, path, rule and verdict of every row of pages.

    rules: host, path, verdict (allow or block); rows with a null or empty host fit nothing.
    A rule fits its host and all subdomains if the url's path starts with the rule's; the
    longest (host and path together) wins, at equal length the longer host, and of equal rules
    that differ the one that blocks.  No rule: null and the default.  Null urls and urls without
    `://` have an empty host and path.  Repeated rows each get their own row; further columns of
    pages are left out.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    p = p.select("*", reversed_host(F.col("host")).alias("key"), F.xxhash64("page_id", "url").alias("salt"))
    r = rules.where(F.coalesce("host", F.lit("")) != "").select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    r = r.select("*", reversed_host(F.col("host")).alias("key")).dropDuplicates(["host", "path", "verdict"])

    n = p.count()
    ranges = max(spark.sparkContext.defaultParallelism, -(-n // pages_per_range))
    # cuts from a sample of keys; beyond KEYS of them the ranges are a little less even
    share = min(1.0, min(ranges * KEYS_PER_CUT, KEYS) / max(1, n))
    drawn = sorted((x.key, x.salt) for x in p.sample(share, seed=1).select("key", "salt").collect())
    cuts = [drawn[i * len(drawn) // ranges] for i in range(1, ranges)] if drawn else []
    shared = spark.sparkContext.broadcast(cuts)  # one key for each range

    def place(batches):
        cuts = shared.value
        for b in batches:
            at = [bisect.bisect_right(cuts, x) for x in zip(b.column("key").to_pylist(), b.column("salt").to_pylist(), strict=True)]
            yield b.append_column("part", pa.array(at, pa.int32()))

    def spread(batches):
        cuts = shared.value
        for b in batches:
            rows = []
            for x in b.to_pylist():
                low = bisect.bisect_left(cuts, (x["key"], -(1 << 63)))
                high = bisect.bisect_right(cuts, (x["key"] + "\U0010ffff", 0))
                rows += [{**x, "part": k} for k in range(low, high + 1)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("host", pa.string()), ("path", pa.string()), ("verdict", pa.string()), ("key", pa.string()), ("part", pa.int32())]))

    placed = p.mapInArrow(place, "page_id bigint, url string, host string, path string, key string, salt bigint, part int")
    placed = placed.select("part", "key", F.lit(True).alias("is_page"), "page_id", "url", "host", "path", F.lit(None).cast("string").alias("verdict"))
    active = r.mapInArrow(spread, "host string, path string, verdict string, key string, part int")
    active = active.select("part", "key", F.lit(False).alias("is_page"), F.lit(None).cast("bigint").alias("page_id"), F.lit(None).cast("string").alias("url"), "host", "path", "verdict")
    dealt = placed.unionByName(active).repartitionById(ranges, F.col("part")).sortWithinPartitions("key", "is_page")
    out = dealt.drop("part").mapInArrow(_sweep, "page_id bigint, url string, host string, path string, rule string, verdict string")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
