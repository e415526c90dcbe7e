"""Queries of this subpackage and the SQL that gives the same rows."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, html, itq, lm, minhash, packing, pii, quality, urlrules, warc
from .common import cleaned, saved, table

#: The rules of op5 (fixed values).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def pii_key(spark) -> str:
    """The session's key; a published one for these queries on test tables where none is set."""
    return spark.conf.get(pii.KEY_SETTING, "snaptree-demo-key")


def op1_pii(spark, sf_dir):
    """Replaces personal data and secrets in every whole text of documents; n_found: values replaced."""
    return pii.report(table(spark, sf_dir, "documents"), secret=pii_key(spark))


def op2_html(spark, sf_dir):
    """The article of every page, from its whole html."""
    return html.extract(table(spark, sf_dir, "pages"))


def op3_packing(spark, sf_dir):
    """A packing plan of all documents into sequences of the permitted lengths."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_embeddings(spark, sf_dir):
    """Links and components of all vectors at a cosine of 0.9."""
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op5_urls(spark, sf_dir):
    """The verdict of the longest fitting rule for the url of every page."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlrules.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


@cleaned
def op6_warc(spark, sf_dir):
    """Audits the WARC files of all pages against a replica of them.

    In the replica the records of every 40th page have another byte, so another length, those of every 90th page are
    lost, and every 70th page's is there once more behind all others of its file.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    at = F.col("page_id")
    bad, lost, again = at % 40 == 3, at % 90 == 7, at % 70 == 11
    damaged = F.when(bad, F.concat(F.coalesce("html", F.lit("")), F.lit("!"))).otherwise(F.col("html"))
    both = saved(warc.laid_out(pages, other=warc.measured(warc.record(at, F.col("url"), damaged)), lost=F.coalesce(lost, F.lit(False)), again=F.coalesce(again, F.lit(False))))
    good = both.select("file", "offset", "length", "record_id", "digest")
    held = both.where("not lost").select("file", "offset", "other.length", "record_id", "other.digest")
    more = both.where("again").select("file", (F.col("offset") + (1 << 40)).alias("offset"), "other.length", "record_id", "other.digest")
    return warc.audit(good, held.unionByName(more))


def op7_quality(spark, sf_dir):
    """Measures and verdict of every whole text."""
    q = quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words", "base_failed", "kept")


def op8_bpe(spark, sf_dir):
    """Digests of the ids and of the decoded bytes of every whole text."""
    import public_tokenizers

    ranks = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(table(spark, sf_dir, "documents"), "doc_id", "text", ranks, public_tokenizers.PATTERN)


def op9_minhash(spark, sf_dir):
    """Components of documents whose sets of three-word shingles overlap by 85 %."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_lm(spark, sf_dir):
    """Base score and score under the model of three words of every whole text."""
    return lm.score(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_html, op3_packing, op4_embeddings, op5_urls, op6_warc, op7_quality, op8_bpe, op9_minhash, op10_lm)}

_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

ORACLE_SQL = {
    "op4_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT c.a AS vec_id, coalesce(n, 0) AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN n ON n.a = c.a""",
    "op5_urls": """
WITH r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT s.page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY s.page_id)
SELECT s.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN m USING (page_id)""",
    "op6_warc": """
WITH r AS (SELECT page_id, (row_number() OVER (ORDER BY page_id) - 1) // 1000 AS file, strlen('WARC/1.1' || 'WARC-Type: resource' || 'WARC-Record-ID: <urn:page:' || page_id || '>' || 'WARC-Date: 1970-01-01T00:00:00Z'
 || 'WARC-Target-URI: ' || coalesce(url, '') || 'Content-Type: text/html' || 'Content-Length: ' || strlen(coalesce(html, '')) || coalesce(html, '')) + 20 AS n FROM pages),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM r)
SELECT CAST(file AS BIGINT) AS file, CAST(off AS BIGINT) AS "offset", page_id AS record_id, CASE WHEN page_id % 90 = 7 THEN 'missing' ELSE 'corrupt' END AS status
FROM o WHERE page_id % 90 = 7 OR page_id % 40 = 3 UNION ALL SELECT file, off + 1099511627776, page_id, 'extra' FROM o WHERE page_id % 70 = 11""",
    "op7_quality": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, len(w) AS nw, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
v AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM k, (VALUES (0), (1), (2)) AS z(d) WHERE c > 1 GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(w, 'string_agg', '')) AS BIGINT) AS wc,
 CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, coalesce(v.n, 0) AS n_repeat_words,
 len(list_intersect(list_transform(w, lambda y: lower(y)), [{_STOPS}])) AS n_stop, len(list_filter(w, lambda y: lower(y) IN ({_STOPS}))) AS n_stops FROM w LEFT JOIN v USING (doc_id)),
b AS (SELECT *, coalesce(wc, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND word_chars / n_words BETWEEN 3 AND 10 AND n_symbols / n_words <= 0.1 AND n_stop >= 2 AND n_stops / n_words >= 0.05 AND n_dup_lines / n_lines <= 0.5 AS kept FROM b""",
    "op9_minhash": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT a AS doc_id, coalesce(n, 0) AS n_shingles, component_id, a = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = a""",
}
