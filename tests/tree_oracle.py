"""A plain tree implementation of the diff, for comparison on small inputs."""
from __future__ import annotations

CHANGES = ("Added", "Removed", "Modified", "Move", "Copy")


class Node:
    def __init__(self, name, parent):
        self.name, self.parent, self.kids, self.twin, self.file = name, parent, {}, None, False
        self.a = self.b = None  # (hash, size) or None
        self.dir_a = self.dir_b = self.matched = False
        self.status, self.source = "Unchanged", None

    @property
    def path(self):
        return "" if self.parent is None else f"{self.parent.path}/{self.name}"

    def sorted(self):
        return [self.kids[k] for k in sorted(self.kids, key=lambda x: x.encode())]


def leaf_status(n):
    if n.b is None:
        return "Removed"
    if n.a is None:
        return "Added"
    return "Unchanged" if n.a[0] is not None and n.a[0] == n.b[0] else "Modified"


def build(a, b):
    root = Node("", None)
    for side, files in (("a", a), ("b", b)):
        for path, rec in files.items():
            n = root
            setattr(n, f"dir_{side}", True)
            for i, x in enumerate(parts := [p for p in path.split("/") if p]):
                n = n.kids.setdefault(x, Node(x, n))
                if i < len(parts) - 1:
                    setattr(n, f"dir_{side}", True)
            n.file = True
            setattr(n, side, rec)
            n.status = leaf_status(n)
    return root


def split(n):
    for k in n.kids.values():
        split(k)
    if n.file and n.kids:
        t = n.twin = Node(n.name, n.parent)
        t.file, t.a, t.b = True, n.a, n.b
        t.status = leaf_status(t)
        n.file, n.a, n.b, n.status = False, None, None, "Unchanged"


def content(n, side):
    """The set of (relative path, twin, hash) below a directory, or a file's hash."""
    if n.file:
        rec = getattr(n, side)
        return rec[0] if rec else None
    out = set()
    for k in n.kids.values():
        for x, tag in ((k, False), (k.twin, True)):
            if x is None:
                continue
            c = content(x, side)
            if x.file:
                out |= {(k.name, tag, c)} if c is not None else set()
            elif c:
                out |= {(f"{k.name}/{r}", t, h) for r, t, h in c}
    return frozenset(out) or None


def propagate(n):
    status, unch = own(n)
    if n.twin is None:
        return status, unch
    if n.twin.status == "Unchanged":
        return status, True
    if n.twin.status != status:
        n.status = "Mixed"
        return "Mixed", unch
    return status, unch


def own(n):
    if n.file:
        return n.status, n.status == "Unchanged"
    if n.matched:
        return n.status, False
    n.source = None
    kids = [(*propagate(k), k.source) for k in n.sorted()]
    n.status, n.source, unch = decide(kids, n.dir_a)
    return n.status, unch


def decide(kids, dir_a):
    s = [k[0] for k in kids]
    unch = any(k[1] for k in kids)
    if all(x == "Unchanged" for x in s):
        return "Unchanged", None, True
    if all(x == "MovedSource" for x in s):
        return "MovedSource", None, False
    if all(x in ("Removed", "MovedSource") for x in s):
        return "Removed", None, False
    n = sum(x in CHANGES for x in s)
    all_add = all(x in ("Added", "Copy", "Move", "MovedSource") for x in s)
    if not dir_a and all_add and (not {"Move", "Copy"} & set(s) or n > 1):
        return "Added", None, False
    if not unch and (all_add or n >= 2):
        if "Modified" in s:
            return "Modified", None, unch
        if all_add and "MovedSource" not in s:
            kinds = {"Move", "Copy", "Added"} & set(s)
            if len(kinds) > 1:
                return "Modified", None, unch
            kind = kinds.pop()
            if kind == "Added":
                return "Added", None, False
            if n == 1:
                return "Mixed", None, unch
            return kind, next(k[2] for k in kids if k[0] == kind and k[2]), False
        return ("Modified" if dir_a else "Added"), None, False
    return "Mixed", None, unch


def walk(n):
    yield n
    if n.twin:
        yield n.twin
    for k in n.sorted():
        yield from walk(k)


def match(root, moves, copies):
    if not moves and not copies:
        return
    removed, modified, every = {}, {}, {}
    nodes = list(walk(root))
    for n in nodes:
        in_a = n.a is not None if n.file else n.dir_a
        h = content(n, "a")
        if not in_a or n.status == "Added" or h is None or n.file and n.a[1] == 0:
            continue
        every.setdefault(h, []).append(n)
        if n.status == "Removed":
            removed.setdefault(h, []).append(n)
        elif n.status == "Modified":
            modified.setdefault(h, []).append(n)
    done = []
    for n in nodes:
        in_a, in_b = (n.a is not None, n.b is not None) if n.file else (n.dir_a, n.dir_b)
        h = content(n, "b")
        if not in_b or n.status not in ("Added", "Modified") or h is None or n.file and n.b[1] == 0 or not n.file and in_a:
            continue
        if moves and removed.get(h):
            src = removed[h].pop(0)
            done.append((n, "Move", src, True))
        elif moves and n.status == "Modified" and modified.get(h):
            done.append((n, "Move", modified[h].pop(0), False))
        elif copies and modified.get(h):
            done.append((n, "Copy", modified[h].pop(0), False))
        elif copies and every.get(h):
            done.append((n, "Copy", every[h].pop(0), False))
    for n, status, src, marks in done:
        n.source = (src.path or "/") if src.file else src.path + "/"
    for n, status, src, marks in done:
        n.status, n.matched = status, True
        if marks:
            src.status = "MovedSource"


def stats(n):
    c = dict.fromkeys(("Added", "Removed", "Modified", "Copy", "Move", "Unchanged", "dirs"), 0)
    if n.file:
        if n.status in c:
            c[n.status] = 1
        return c
    if n.status == "Unchanged":
        c["dirs"] = 1
    for x in [n.twin, *n.kids.values()]:
        if x:
            for k, v in stats(x).items():
                c[k] += v
    return c


def line(path, status, source, c, hidden=0):
    return (path.lstrip("/") if path != "." else path, status, source, c["Added"], c["Removed"], c["Modified"], c["Copy"], c["Move"], c["Unchanged"], c["dirs"], hidden)


class Collector:
    def __init__(self, show, budget):
        self.out, self.show, self.budget = [], show, budget

    def collect(self, n):
        if n.parent is not None and n.twin is not None:
            pair = (n.twin, n) if n.twin.status in ("Removed", "MovedSource") else (n, n.twin)
            for x in pair:
                self.node(x)
        else:
            self.node(n)

    def kids(self, n):
        start = len(self.out)
        for k in n.sorted():
            self.collect(k)
        rest = self.out[start + self.budget :] if self.budget and n.parent is not None else []
        if rest:
            total = [sum(r[i] for r in rest) for i in range(3, 11)]
            total[-1] += len(rest)
            self.out[start + self.budget :] = [((n.path + "/").lstrip("/"), "Truncated", None, *total)]

    def node(self, n):
        if n.parent is None or n.status == "Mixed":
            self.kids(n)
            c = stats(n)
            if self.show and (c["Unchanged"] or c["dirs"]):
                c |= dict.fromkeys(("Added", "Removed", "Modified", "Copy", "Move"), 0)
                self.out.append(line("." if n.parent is None else n.path + "/", "Mixed", n.source, c))
        elif n.status in CHANGES:
            c = stats(n)
            if not n.file and not self.show or n.file:
                c |= {"Unchanged": 0, "dirs": 0}
            self.out.append(line(n.path + ("" if n.file else "/"), n.status, n.source, c))


def reinstate(n, named):
    def mentioned(p):
        p = p.rstrip("/")
        while p:
            if p in named:
                return True
            p = p.rpartition("/")[0]
        return False

    if n.status == "MovedSource":
        if mentioned(n.path):
            return False
        demote(n)
        return True
    changed = False
    if n.twin and n.twin.status == "MovedSource" and not mentioned(n.path):
        n.twin.status = "Removed"
        changed = True
    for k in n.kids.values():
        changed |= reinstate(k, named)
    return changed


def demote(n):
    for x in (n, n.twin):
        if x and x.status == "MovedSource":
            x.status = "Removed"
    for k in n.kids.values():
        demote(k)


def diff(a, b, moves=True, copies=True, show=False, budget=0):
    """Lines (path, status, source, seven counts, hidden) of two maps of path to (hash, size)."""
    root = build(a, b)
    split(root)
    propagate(root)
    match(root, moves, copies)
    propagate(root)
    c = Collector(show, budget)
    c.collect(root)
    for _ in range(32):
        named = {"/" + x[2].strip("/") for x in c.out if x[1] == "Move" and x[2]} | {"/" + x[0].rstrip("/") for x in c.out if x[1] in ("Removed", "Modified")}
        if not reinstate(root, named):
            break
        propagate(root)
        c = Collector(show, budget)
        c.collect(root)
    return c.out
