import pytest
from pyspark.sql import functions as F

from snaptree.llm import queries, warc


def test_audit(spark):
    rows = [(i, f"http://x/{i}", "é" * (i * 31 % 5000)) for i in range(2500)] + [(None, None, None), (7000, "u", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("leaf", F.lit("clash")).withColumn("node", F.lit(1))
    good = warc.manifest(pages)
    assert warc.audit(good, good).count() == 0
    other = good.where("record_id is null or record_id not in (3, 1999)").withColumn("digest", F.when(F.col("record_id").isin(10, 1234), "bad").otherwise(F.col("digest")))
    other = other.withColumn("length", F.when(F.col("record_id") == 77, F.col("length") + 1).otherwise(F.col("length")))
    more = spark.createDataFrame([(50, 0, 9, 50000, "d")], "file bigint, offset bigint, length bigint, record_id bigint, digest string")
    got = {(r.record_id, r.status) for r in warc.audit(good, other.unionByName(more)).collect()}
    assert got == {(3, "missing"), (1999, "missing"), (10, "corrupt"), (1234, "corrupt"), (77, "corrupt"), (50000, "extra")}
    assert {r.status for r in warc.audit(good.limit(0), more).collect()} == {"extra"} and warc.audit(good.limit(0), good.limit(0)).count() == 0
    doubled = more.unionByName(more)
    assert [r.status for r in warc.audit(doubled, more).collect()] == ["corrupt"] and warc.audit(doubled, doubled).count() == 0
    with pytest.raises(Exception, match="no file or offset"):
        warc.audit(more.withColumn("offset", F.lit(None).cast("bigint")), more).collect()


def test_records(spark):
    df = spark.createDataFrame([(1, "http://x", "a\r\n\r\nbé"), (2, None, None)], "page_id bigint, url string, html string")
    p = df.select(warc.parse_record(warc.record(F.col("page_id"), F.col("url"), F.col("html"))).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in p] == [("<urn:page:1>", "http://x", 8, "a\r\n\r\nbé"), ("<urn:page:2>", "", 0, "")]
    rows = warc.manifest(df).orderBy("offset").collect()
    assert [r.offset for r in rows] == [0, rows[0].length]


def test_query_on_repeated_and_null_pages(spark, tmp_path):
    """Undamaged copies of a page, and pages without a number, are sound; copies of a damaged one are corrupt."""
    rows = [(1, "u", "a"), (1, "u", "a"), (3, "v", "b"), (3, "v", "b"), (7, "w", "c"), (11, "x", "d"), (None, "y", "e"), (None, None, None)] + [(2, "z", "same")] * 2500
    spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("file", F.lit("clash")).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((q.record_id, q.status) for q in queries.op6_warc(spark, str(tmp_path)).collect())
    assert got == [(3, "corrupt"), (3, "corrupt"), (7, "missing"), (11, "extra")]
    most = warc.manifest(spark.read.parquet(f"{tmp_path}/pages.parquet")).groupBy("file").count().agg(F.max("count")).first()[0]
    assert most == warc.FILE_PAGES


def test_files(spark, tmp_path):
    """Files that are written by hand are read back, with damage in the place where it is."""
    rows = [(i, f"http://x/{i}", "é" * (i * 77 % 900)) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    raw = [r.r.encode() for r in df.orderBy("page_id").select(warc.record(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).collect()]
    for name, part in (("a", raw), ("b", [*raw[:5], raw[5].replace(b"urn:page:5", b"urn:page:6"), *raw[6:20], b"x" + raw[20][1:], *raw[21:39]])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "one.warc").write_bytes(b"".join(part))
    a, b = warc.read(spark, f"file://{tmp_path}/a"), warc.read(spark, f"file://{tmp_path}/b")
    want = [(r.offset, r.length, r.record_id, r.digest) for r in warc.manifest(df).orderBy("offset").collect()]
    assert [(r.offset, r.length, r.record_id, r.digest) for r in a.orderBy("offset").collect()] == want
    got = sorted((r.record_id if r.record_id is not None else -1, r.status) for r in warc.audit(a, b).collect())
    assert got == [(5, "missing"), (6, "extra"), (20, "corrupt"), (39, "missing")]


def test_very_long_record(spark):
    df = spark.createDataFrame([(1, "u", "é" * 3_000_000), (2, "u", "")], "page_id bigint, url string, html string")
    good = warc.manifest(df)
    bad = warc.manifest(df.withColumn("html", F.when(F.col("page_id") == 1, F.concat(F.substring("html", 2, 2_999_999), F.lit("è"))).otherwise(F.col("html"))))
    assert [(r.record_id, r.status) for r in warc.audit(good, bad).collect()] == [(1, "corrupt")]
