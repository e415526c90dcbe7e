"""Sizes, patterns and timestamps."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def parse_size(text: str) -> int:
    """Bytes that `10M`, `1.5G` or `2KB` names (powers of 1024); empty is 0."""
    if not text.strip():
        return 0
    m = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)B?", text.strip().upper())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * _UNITS[m[2]])


def format_bytes(n: int) -> str:
    if n < 1024:
        return f"{n} B"
    for unit in ("KB", "MB", "GB", "TB", "PB"):
        n /= 1024
        if n < 1024 or unit == "PB":
            return f"{n:.1f} {unit}"
    raise AssertionError


def thousands(n: int) -> str:
    return f"{n:,}"


def plural(n: int, word: str, many: str | None = None) -> str:
    """`1 file`, `2,000 files`; many: the plural if it is not the word and an s."""
    return f"{thousands(n)} {word if n == 1 else many or word + 's'}"


def duration(seconds: float) -> str:
    """`45s`, `3m 5s`, `2h 0m`: the two largest units."""
    s = max(0, round(seconds))
    h, m, s = s // 3600, s // 60 % 60, s % 60
    return f"{h}h {m}m" if h else f"{m}m {s}s" if m else f"{s}s"


def remaining(elapsed: float, done: int, total: int) -> float | None:
    """Seconds left at the average rate so far; None before there is a rate, or without a total."""
    if elapsed <= 0 or done <= 0 or total <= 0:
        return None
    return max(0.0, (total - done) * elapsed / done)


def text_table(head: list[str], rows: list[list[str]]) -> str:
    """Columns as wide as their widest cell, two spaces apart, with a rule below the head."""
    if any(len(r) != len(head) for r in rows):
        raise ValueError("a row has not as many cells as the head")
    wide = [max(len(r[i]) for r in [head, *rows]) for i in range(len(head))]
    line = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, wide, strict=True)).rstrip()
    return "\n".join([line(head), line(["-" * w for w in wide]), *map(line, rows)])


def hash_bytes(text: Column) -> Column:
    """The bytes that a hash spells in hexadecimal, 20 at most; the SHA-1 of any other text; null for null and empty ones."""
    raw = F.when(text.rlike(r"\A(?:[0-9a-fA-F]{2}){1,20}\z"), F.unhex(text)).otherwise(F.unhex(F.sha1(text)))
    return F.when(text != "", raw)


def glob_to_regex(glob: str) -> str:
    """A regular expression for a shell pattern on names: `*` and `?` stay within a component; classes and escapes work."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == len(glob):
                raise ValueError("the pattern ends in an escape")
            out.append(re.escape(glob[i]))
            i += 1
        elif c == "[":
            negated = glob[i : i + 1] == "^"
            i += negated
            items = []
            while i < len(glob) and (glob[i] != "]" or not items):
                lo, i = _member(glob, i)
                hi = lo
                if glob[i : i + 1] == "-":
                    hi, i = _member(glob, i + 1)
                if ord(hi) < ord(lo):
                    items.append("")  # an empty range holds nothing
                    continue
                items.append(f"\\x{{{ord(lo):x}}}-\\x{{{ord(hi):x}}}")
            if i >= len(glob):
                raise ValueError("a class is not closed")
            i += 1
            held = "".join(items)
            out.append(f"[{'^' if negated else ''}{held}]" if held else "[^/]" if negated else "[^\\s\\S]")
        else:
            out.append(re.escape(c) if not c.isalnum() else c)
    return "(?s)\\A" + "".join(out) + "\\z"


def _member(glob: str, i: int) -> tuple[str, int]:
    """The character of a class at place i and the place after it; `-` and `]` have to be escaped."""
    if i < len(glob) and glob[i] in "-]":
        raise ValueError(f"a class holds {glob[i]!r} without an escape")
    if glob[i : i + 1] == "\\":
        i += 1
    if i >= len(glob):
        raise ValueError("a class is not closed")
    return glob[i], i + 1


def matches_glob(name: Column, glob: str, case_sensitive: bool = False) -> Column:
    return name.rlike(glob_to_regex(glob)) if case_sensitive else F.lower(name).rlike(glob_to_regex(glob.lower()))


def matches_regex(name: Column, pattern: str, case_sensitive: bool = True) -> Column:
    return name.rlike(pattern if case_sensitive else f"(?i){pattern}")


def timestamp(text: Column) -> Column:
    """The instant of a text in any of the four stored layouts, in UTC; null if it has none of them."""
    t = F.regexp_replace(text, r" ([+-][0-9]{4}) [A-Z]+( m=.*)?$", "$1")
    return F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSSSSSxx")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ssxx")))


def hash_or_null(text: Column) -> Column:
    """A hash in lower case; empty texts and `-` are no hash."""
    t = F.lower(F.trim(text))
    return F.when((t != "") & (t != "-"), t)
