"""WARC records and a Merkle fixity audit of two replicas.

Leaves are digests of records.  Records are gathered by ranges of offsets (RANGE bytes of a
file), and FANOUT ranges make the next level, up to one root for each file.  The audit
compares roots and descends level by level, and only below nodes that differ.
"""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rank import ranked
from .common import cleaned, saved

#: Bytes of a file in a range of the lowest level; children of a node above.
RANGE, FANOUT = 65536, 16
#: Records in a file.
FILE_PAGES = 1000
#: Date of records whose capture time is not known (fixed value).
NO_DATE = "1970-01-01T00:00:00Z"


def record(page_id: Column, url: Column, html: Column, date: Column | None = None) -> Column:
    """The bytes of a WARC/1.1 resource record, as a string; a null url or html counts as empty, a null date as NO_DATE."""
    body = F.coalesce(html, F.lit(""))
    when = F.lit(NO_DATE) if date is None else F.coalesce(F.date_format(F.to_utc_timestamp(date, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(NO_DATE))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Date: "), when,
        F.lit("\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def parse_record(raw: Column) -> Column:
    """struct(record_id, url, length, body) of a record."""
    head = F.substring_index(raw, "\r\n\r\n", 1)
    field = lambda name: F.regexp_extract(head, rf"(?m)^{name}: *(.*?)\r?$", 1)
    n = F.try_to_number(field("Content-Length"), F.lit("9999999999999999999")).cast("bigint")
    body = F.substring(raw.cast("binary"), F.octet_length(head) + 5, n.cast("int")).cast("string")
    return F.struct(field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("url"), n.alias("length"), body.alias("body"))


def measured(raw: Column) -> Column:
    """struct(length, digest) of a record."""
    return F.struct(F.octet_length(raw).cast("bigint").alias("length"), F.sha2(raw, 256).alias("digest"))


def laid_out(pages: DataFrame, **extra: Column) -> DataFrame:
    """file, offset, length, record_id, digest, and the extra columns, of pages in WARC files of FILE_PAGES records in the order of page_id.

    Pages are numbered by their rank, so repeated and null page_ids fill files like others.
    """
    own = measured(record(F.col("page_id"), F.col("url"), F.col("html")))
    r = pages.select(F.col("page_id").cast("bigint").alias("record_id"), own.alias("m"), *[c.alias(n) for n, c in extra.items()])
    r = r.select("record_id", "m.length", "m.digest", *extra, F.lit(0).alias("all"), F.monotonically_increasing_id().alias("place"))
    r = ranked(r, ["all"], ["record_id", "digest", "place"]).withColumn("file", F.floor((F.col("rank") - 1) / FILE_PAGES).cast("bigint"))
    w = Window.partitionBy("file").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # FILE_PAGES rows
    return r.select("file", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("offset"), "length", "record_id", "digest", *extra)


def manifest(pages: DataFrame) -> DataFrame:
    """file, offset, length, record_id, digest of pages as they are laid out in WARC files; see laid_out()."""
    return laid_out(pages)


def read(spark: SparkSession, path: str) -> DataFrame:
    """file (its path's name), offset, length, record_id, digest of the records of uncompressed WARC files.

    record_id: the number in a record's `<urn:page:...>`, else null.  Bytes that are no record, as after damage, are
    one record with a null id up to the next line that starts one, so no byte is left out.  A file is one row: it has to fit a task.
    """
    start = re.compile(rb"WARC/1\.[01]\r\n")

    def run(batches):
        import hashlib

        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                at, out = 0, []
                while at < len(raw):
                    head = start.match(raw, at)
                    end = raw.find(b"\r\n\r\n", at) if head else -1
                    size = re.search(rb"(?mi)^Content-Length: *([0-9]+)\r?$", raw[at:end]) if end >= 0 else None
                    stop = end + 8 + int(size[1]) if size else len(raw) + 1
                    if stop > len(raw) or raw[stop - 4 : stop] != b"\r\n\r\n":
                        later = start.search(raw, at + 1)
                        stop = later.start() if later else len(raw)
                    key = re.search(rb"(?mi)^WARC-Record-ID: *<urn:page:(-?[0-9]{1,18})>\r?$", raw[at : end if 0 <= end < stop else stop])
                    out.append((name.rsplit("/", 1)[-1], at, stop - at, int(key[1]) if key else None, hashlib.sha256(raw[at:stop]).hexdigest()))
                    at = stop
                yield pd.DataFrame(out, columns=["file", "offset", "length", "record_id", "digest"]).astype({"record_id": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, offset bigint, length bigint, record_id bigint, digest string")


def _leaf(side: str, df: DataFrame) -> DataFrame:
    own = F.sha2(F.concat_ws("|", F.coalesce(F.col("record_id").cast("string"), F.lit("")), "offset", "length", F.coalesce("digest", F.lit(""))), 256)
    return df.select(F.lit(side).alias("side"), "file", "offset", "record_id", "length", "digest", F.floor(F.col("offset") / RANGE).cast("bigint").alias("node"), own.alias("leaf"))


def _up(nodes: DataFrame) -> DataFrame:
    return (
        nodes.groupBy("side", "file", F.floor(F.col("node") / FANOUT).cast("bigint").alias("up"))
        .agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["hash"])), ","), 256).alias("hash"))
        .withColumnRenamed("up", "node")
    )


def _differ(nodes: DataFrame) -> DataFrame:
    """file and node where the replicas' hashes are not the same."""
    a, b = F.max(F.when(F.col("side") == "a", F.col("hash"))), F.max(F.when(F.col("side") == "b", F.col("hash")))
    return nodes.groupBy("file", "node").agg(a.alias("a"), b.alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "node")


@cleaned
def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """file, offset, record_id, status of each record in which the replicas differ.

    a, b: file, offset, length, record_id, digest (further columns are ignored).  status: corrupt (both have
    the record, with other bytes or another length), missing (only a has it) or extra (only b).  Repeated
    rows are compared as a multiset: one row too few is corrupt.  Null record ids and digests are values
    like others; rows with a null file or offset cannot be placed and are refused when a row is read.
    Empty replicas: all records of the other are missing or extra.
    """
    both = _leaf("a", a).unionByName(_leaf("b", b))
    placed = F.when(F.col("file").isNull() | F.col("offset").isNull(), F.raise_error(F.lit("a record has no file or offset"))).otherwise(F.col("node"))
    leaves = saved(both.withColumn("node", placed))
    # ordered ranges: a range holds RANGE / (least record length) digests at most
    level = leaves.groupBy("side", "file", "node").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "leaf"))), lambda x: x["leaf"]), ","), 256).alias("hash"))
    levels = [saved(level)]
    top = levels[0].agg(F.max("node")).first()[0] or 0
    while top > 0:
        levels.append(saved(_up(levels[-1])))
        top //= FANOUT
    bad = _differ(levels[-1])
    for below in reversed(levels[:-1]):
        bad = bad.withColumnRenamed("node", "up")
        inside = below.withColumn("up", F.floor(F.col("node") / FANOUT).cast("bigint")).join(bad, ["file", "up"], "left_semi")
        bad = _differ(inside)
    suspect = leaves.join(bad, ["file", "node"], "left_semi")
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("leaf"))))
    seen = suspect.groupBy("file", "offset", "record_id").agg(side("a").alias("a"), side("b").alias("b"))
    status = F.when(F.size("b") == 0, "missing").when(F.size("a") == 0, "extra").otherwise("corrupt")
    return seen.where(F.col("a") != F.col("b")).select("file", "offset", "record_id", status.alias("status"))
