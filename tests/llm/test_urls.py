import random
import re

from pyspark.sql import functions as F

from snaptree.llm import urlrules


def plain(url, rules, default="allow"):
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None, key=lambda f: (f[0], f[1], f[3] == "block"))
    return host, path, best and best[2], best[3] if best else default


def test_against_brute_force(spark):
    r = random.Random(4)
    labels = ["a", "b", "com", "net", "x-1"]
    host = lambda n: ".".join(r.choice(labels) for _ in range(r.randint(1, n)))
    path = lambda: "".join(r.choice(["/", "/en/", "a", "b"]) for _ in range(r.randint(0, 3)))
    rules = list({(host(3), path(), r.choice(["allow", "block"])) for _ in range(60)})
    urls = [f"{r.choice(['http', 'https'])}://{host(4).upper() if i % 7 == 0 else host(4)}{'/' + path() if i % 3 else ''}{r.choice(['', '?q=://x/', '#f'])}" for i in range(900)]
    urls += ["http://a.com/hot"] * 400 + [None, "", "no scheme/a", "://", "://é.com/É", "http://a.com?x", "http://a.com." + "/en/" * 3000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("key", F.lit(1)).withColumn("host", F.lit("clash"))
    told = spark.createDataFrame([*rules, (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    got = {q.page_id: (q.host, q.path, q.rule, q.verdict) for q in urlrules.judge(pages, told, pages_per_range=100).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}
    none = urlrules.judge(pages, told.limit(0), default="block").collect()
    assert len(none) == len(urls) and {(q.rule, q.verdict) for q in none} == {(None, "block")}
    assert urlrules.judge(pages.limit(0), told).count() == 0
