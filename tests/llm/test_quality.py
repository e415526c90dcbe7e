import random
import re
from collections import Counter

from pyspark.sql import functions as F

from snaptree.llm import quality


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    rep = len({i + d for i, g in enumerate(grams) if n[g] > 1 for d in range(3)})
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(lines), rep, len({x.lower() for x in w} & set(quality.STOP_WORDS)), sum(x.lower() in quality.STOP_WORDS for x in w)


def test_against_brute_force(spark):
    r = random.Random(2)
    texts = [None, "", " \t\n\x0b\x0c\r ", "a b", "a b c", "a b c a b c", "x " * 30000, "  é ü # | <>", "l\nl\n l\nl\n", "The of and " * 40]
    for n in (5, 80, 300):
        for k in (3, 12, 4000):
            texts += ["".join(r.choice(["the", "of", "w", "Zürich", "#", "&x"]) + str(r.randrange(k)) * (r.random() < 0.8) + r.choice([" ", "\n", "\t", "  "]) for _ in range(n))]
    good = " ".join(f"the word{i} of sense{i * 7}" for i in range(40))
    texts += [good, good]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("n_words", F.lit("clash")).withColumn("kind.of", F.lit(1))
    got = {q.doc_id: q for q in quality.quality(df).collect()}
    for i, t in enumerate(texts):
        want = plain(t)
        assert tuple(got[i]["_q"]) == want, i
        n, chars, sym, dup, lines, rep, stops, stop_words = want
        base = n < 50 or 100 * rep > 50 * n
        kept = not base and 3 <= chars / n <= 10 and sym / n <= 0.1 and stops >= 2 and stop_words / n >= 0.05 and dup / lines <= 0.5
        assert (got[i].base_failed, got[i].kept) == (base, kept), i
    assert got[len(texts) - 1].kept and got[len(texts) - 2].kept
    out = quality.keep_good(df)
    assert out.columns == df.columns and sorted(q.doc_id for q in out.collect()) == sorted(i for i, q in got.items() if q.kept)
    assert quality.quality(df.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([("a",)], "text string")
    plan = quality.quality(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_columns_of_any_name_stay(spark):
    good = " ".join(f"the word{i} of sense{i * 7}" for i in range(40))
    names = ["kept", "base_failed", "_q", "_t", "t", "w", "q", "ok", "bits", "bucket", "gone", "A.b", "_gone"]
    df = spark.createDataFrame([(1, good, *range(len(names))), (2, None, *range(len(names))), (3, good, *range(len(names)))], ["doc_id", "text", *names])
    out = quality.keep_good(df)
    assert out.columns == df.columns and sorted(tuple(r) for r in out.collect()) == [(i, good, *range(len(names))) for i in (1, 3)]
    assert [r.kept for r in quality.quality(df).orderBy("doc_id").collect()] == [True, False, True]
    from snaptree.llm import minhash

    first = minhash.keep_first(df)
    assert first.columns == df.columns and sorted(r.doc_id for r in first.collect()) == [1, 2]


def test_texts_beyond_the_packing_of_positions(spark):
    """Texts of 2**20 words and more take the exact way; their counts are those of the plain version."""
    n = 1 << quality.POSITION_BITS
    for words in (n - 1, n + 3):
        t = " ".join(f"w{i % (words - 3)}" for i in range(words))
        got = quality.quality(spark.createDataFrame([(1, t)], "doc_id int, text string")).first()
        assert tuple(got["_q"])[0::5] == (words, 6)
