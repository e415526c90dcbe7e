import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snaptree.llm import bpe

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load(public.path("byte_bpe_50k.tiktoken"))


def test_as_the_library(spark, ranks):
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    texts = [None, "", " ", "Hello, world!  It's 2024.\n\n\tnew", "naïve Ünïcödé 日本語 🙂👍🏽 \u0000​", "a" * 20000, " " * 5000 + "x", "<|endoftext|>", "ab" * 3000]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2000), r.randrange(0x4E00, 0x9FFF), 0x1F600])) for _ in range(200)) for _ in range(20)]
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id int, text string").withColumn("ids", F.lit("clash"))
    got = {}
    for q in bpe.encode(df, "doc_id", "text", ranks, public.PATTERN).collect():
        want = enc.encode_ordinary(texts[q.doc_id] or "")
        assert np.frombuffer(q.ids, "<u4").tolist() == want and q.n_tokens == len(want) and bytes(q.decoded) == (texts[q.doc_id] or "").encode()
        got[q.doc_id] = (len(want), hashlib.sha256(bytes(q.ids)).hexdigest(), hashlib.sha256(bytes(q.decoded)).hexdigest())
    rows = bpe.digests(df, "doc_id", "text", ranks, public.PATTERN).collect()
    assert len(rows) == len(texts) + 1 and all((q.n_tokens, q.ids_sha256, q.decoded_sha256) == got[q.doc_id] for q in rows)
    assert bpe.digests(df.limit(0), "doc_id", "text", ranks, public.PATTERN).count() == 0


def test_perfect_hash(ranks):
    small = {bytes([i, j]): i * 256 + j for i in range(40) for j in range(20)}
    h = bpe.PerfectHash(small)
    assert all(h.get(k) == v for k, v in small.items()) and h.get(b"zz9") is None and h.get(b"") is None
    assert None not in h.keys and len(h.keys) == len(small)  # minimal
    assert bpe.PerfectHash({}).get(b"a") is None


def test_merge_of_equal_ranks_is_leftmost():
    ranks = {bytes([c]): c for c in range(256)} | {b"aa": 300, b"aaa": 301}
    assert bpe.merge(b"aaaaa", ranks) == [300, 301] and bpe.merge(b"a", ranks) == [97]
