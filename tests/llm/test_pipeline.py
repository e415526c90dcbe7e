"""The pipeline against its stages in plain Python, and the rows that the contract names."""
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import plain_pii  # noqa: E402
import test_minhash  # noqa: E402
import test_quality  # noqa: E402

import corpus_pipeline  # noqa: E402
from snaptree.llm import packing, quality, queries  # noqa: E402


def test_run(spark, tmp_path):
    good = lambda s: " ".join(f"the word{s * i} of sense{i * 7 + s}" for i in range(40))
    docs = [(1, good(3)), (2, good(3) + " more"), (3, good(5) + " ann@example.org"), (4, "short"), (5, None), (6, ""), (7, good(3)), (8, good(11) + " 4111 1111 1111 1111")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("bigint"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    long = {q.doc_id for q in quality.keep_good(df).collect()}
    left = [(i, t) for i, t in docs if i in long]
    want = {i for i, (_, c) in test_minhash.classes(left, 5, 80).items() if i == c}
    assert {q.doc_id for q in got} == want == {1, 3, 8} and all(q.n_tokens == len(dict(docs)[q.doc_id].split()) + 1 for q in got)
    at = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == df.columns, name
    texts = {q.doc_id: q.text for q in at.collect()}
    assert "ann@" not in texts[3] and "4111 1111" not in texts[8] and texts[1] == docs[0][1]
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_all_queries_are_registered():
    numbers = sorted(int(n[2:].partition("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(corpus_pipeline.STAGES) == 4


@pytest.mark.parametrize("name", ["op5_urls", "op6_warc"])
def test_extra_columns_and_nulls(spark, tmp_path, name):
    rows = [(1, "http://www.example.com/en/x", "<p>a</p>"), (2, None, None), (3, "x.net", "")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(1)).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    if name == "op5_urls":
        assert sorted(tuple(q) for q in got) == [(1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow")]
    else:
        assert [(q.record_id, q.status) for q in got] == [(3, "corrupt")]


def test_stages_on_documents_against_plain_python(spark, tmp_path):
    """All four stages in plain Python over the smallest table: the rows that go on, their texts, and the bins."""
    source = Path("/root/testdata/sf0.001/documents.parquet")
    if not source.exists():
        pytest.skip("no documents here")
    df = spark.read.parquet(f"file://{source}")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = [(q.doc_id, q.text) for q in df.select("doc_id", "text").collect()]

    def good(t):
        n, chars, symbols, dup, lines, rep, stops, stop_words = test_quality.plain(t)
        return n >= 50 and 100 * rep <= 50 * n and 3 <= chars / n <= 10 and symbols / n <= 0.1 and stops >= 2 and stop_words / n >= 0.05 and dup / lines <= 0.5

    left = [(i, t) for i, t in docs if good(t)]
    first = {i for i, (_, c) in test_minhash.classes(left, 5, 80).items() if i == c}
    texts = {i: plain_pii.replaced(t, queries.pii_key(spark))[1] for i, t in left if i in first}
    at = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.saved(stage(spark, at, str(tmp_path)))
        assert at.columns == df.columns, name
    assert {q.doc_id: q.text for q in at.select("doc_id", "text").collect()} == texts and 0 < len(texts) < len(left) < len(docs)
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == {i: len(t.split()) + 1 for i, t in texts.items()}
    for _, own in got.groupby("bin_id"):
        own = own.sort_values("bin_offset")
        fill = int(own.n_tokens.sum())
        assert list(own.bin_offset) == [0, *own.n_tokens.cumsum()][:-1] and set(own.bin_fill) == {fill} and set(own.bin_size) == {min(s for s in packing.SIZES if s >= fill)}
