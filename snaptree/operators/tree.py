"""Directories from files: nodes, totals and content digests, without a tree in memory."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

#: A digest is nine sums of numbers of 28 bits that the entries hash to, 252 bits of SHA-256 in all.
WORDS, DIGITS = 9, 7


def entry_words(*fields: Column) -> list[Column]:
    """Numbers of one entry, from SHA-256 over its length-prefixed fields."""
    framed = F.concat(*[F.concat(F.octet_length(f).cast("string"), F.lit(":"), f) for f in fields])
    h = F.sha2(framed, 256)
    return [F.conv(F.substring(h, 1 + DIGITS * i, DIGITS), 16, 10).cast("bigint") for i in range(WORDS)]


def digest(prefix: str) -> Column:
    """The aggregate over columns prefix0.. of the entries: equal for equal sets, and null for none.

    Sums are reduced before the shuffle, so a directory's entries never meet in one place.  They are kept whole
    (up to 2**35 entries), not modulo a power of two, and unlike exclusive ors they are not undone by solving linear
    equations over a few hundred chosen files.
    """
    return F.when(F.count(f"{prefix}0") > 0, F.concat_ws("-", F.count(f"{prefix}0"), *[F.sum(F.col(f"{prefix}{i}")) for i in range(WORDS)]))


def below(path: Column, up: Column) -> Column:
    """path relative to the directory up above it."""
    return F.when(up == "", path).otherwise(F.substr(path, F.length(up) + 2))
