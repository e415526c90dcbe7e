"""Scalar functions: paths, sizes, patterns."""
