"""Path rules as Column expressions.  Paths may or may not start with a slash."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    """Components of a path; leading, trailing and double slashes do not count.  Arrays of them sort in depth-first order."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def basename(path: Column) -> Column:
    return F.coalesce(F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1), F.lit(""))


def dirname(path: Column) -> Column:
    """The directory of a path: `/` for those at the top, `.` for those without a slash."""
    cut = F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1)
    return F.when(~path.contains("/"), ".").when(cut == "", "/").otherwise(cut)


def joined(p: Column) -> Column:
    return F.array_join(p, "/")


def ancestors(p: Column, itself: bool = False) -> Column:
    """Relative paths of the directories above components p, from the root (``) down; with itself, p's own path too."""
    last = F.size(p) - (0 if itself else 1)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(p, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def parent(path: Column) -> Column:
    """The directory above a relative path; `` for those at the top and for the root itself."""
    return F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1)


def clean(path: str) -> str:
    """A path without double slashes, `.` and `..`; empty stays empty."""
    if not path.strip():
        return ""
    out: list[str] = []
    for x in path.split("/"):
        if x in ("", "."):
            continue
        if x == ".." and out and out[-1] != "..":
            out.pop()
        elif not (x == ".." and path.startswith("/")):
            out.append(x)
    return ("/" if path.startswith("/") else "") + "/".join(out) or "."


def under(path: Column, prefix: str) -> Column:
    """True if path is prefix or lies below it; a sibling that merely begins alike does not.  An empty prefix has nothing below it."""
    x = clean(prefix)
    if not x:
        return F.lit(False)
    if x == "/":
        return path.startswith("/")
    return (path == x) | path.startswith(x + "/")


def relative(path: Column, root: str) -> Column:
    """path below root; a path that is not below root keeps its full form.  Slashes at the start go."""
    x = clean(root)
    at = F.when(path == x, F.lit("")).when(under(path, x), F.substr(path, F.lit(len(x.rstrip("/")) + 2))).otherwise(path)
    return F.ltrim(at, F.lit("/"))


def excluded(path: Column, root: str, excludes) -> Column:
    """True if an exclude applies: absolute ones hold their subtree; relative ones are anchored at root.  Blanks are ignored."""
    found = []
    for x in excludes:
        x = x.strip()
        if not x:
            continue
        if x.startswith("/"):
            found.append(under(path, x))
        else:
            found += [under(path, clean(root).rstrip("/") + "/" + x), under(path, x)]
    return reduce(lambda a, b: a | b, found, F.lit(False))


def rebased(path: Column, old: str, new: str) -> Column:
    """path with the root old replaced by new, if it lies below old."""
    old, new = clean(old), clean(new)
    return F.when(path == old, F.lit(new)).when(under(path, old), F.concat(F.lit(new.rstrip("/") + "/"), F.substr(path, F.lit(len(old.rstrip("/")) + 2)))).otherwise(path)


def common_root(roots) -> str:
    """The lowest directory above all roots."""
    split = [clean(r).strip("/").split("/") for r in roots]
    n = 0
    while split and all(len(s) > n and s[n] == split[0][n] for s in split):
        n += 1
    return ("/" if all(r.startswith("/") for r in roots) else "") + "/".join(split[0][:n] if split else [])


def disjoint(roots) -> bool:
    """True if no root is another one or lies below it."""
    r = sorted(clean(x).rstrip("/") + "/" for x in roots)
    return all(not b.startswith(a) for a, b in zip(r, r[1:]))
