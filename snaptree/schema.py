"""Schemas of the store."""
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType, TimestampType

#: Version of the layout below.
VERSION = 1

FILES = StructType([
    StructField("path", StringType()), StructField("filename", StringType()), StructField("size_bytes", LongType()), StructField("mod_time", TimestampType()),
    StructField("sha1", StringType()), StructField("md5", StringType()),
])
SNAPSHOTS = StructType([
    StructField("id", LongType()), StructField("name", StringType()), StructField("root_path", StringType()), StructField("computer_name", StringType()), StructField("started_at", TimestampType()),
    StructField("finished_at", TimestampType()), StructField("status", StringType()), StructField("hashes", ArrayType(StringType())), StructField("error_count", LongType()),
])
STATUSES = ("in_progress", "completed", "failed", "deleted")
