"""Operators over snapshots: DataFrames of files with path, size_bytes, sha1 and md5 (null: no hash)."""
