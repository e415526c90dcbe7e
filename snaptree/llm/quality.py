"""Quality rules: one threshold table, compiled into a single projection."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, columns, fresh, words

#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in is that it for with on as was be by this are from or an at not have which "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch er es "
    "de la le et les du une que est pour qui dans par sur pas au plus avec ce il un "
    "el en y los del se las con no su al lo como más"
).split()

#: (rule, feature, lowest, highest); None leaves a side open.  A text is kept if every rule holds.
THRESHOLDS = (
    ("length", "n_words", 50, None),
    ("word_length", "mean_word_chars", 3.0, 10.0),
    ("symbols", "symbol_ratio", None, 0.1),
    ("stop_words", "n_stop_words", 2, None),
    ("stop_word_share", "stop_word_ratio", 0.05, None),
    ("duplicate_lines", "dup_line_ratio", None, 0.5),
    ("repetition", "repeat_word_ratio", None, 0.5),
)

#: Bits of a packed long that hold a word's position.
POSITION_BITS = 20


def _any_collision(w: Column, packed: Column) -> Column:
    """True if two neighbours in packed share the hash but not the three words."""
    mask = F.lit((1 << POSITION_BITS) - 1)

    def differs(x, j):
        y = F.get(packed, j + 1)
        a, b = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
        same = F.shiftright(x.bitwiseXOR(y), POSITION_BITS) == 0
        return F.coalesce(same & ((F.get(w, a) != F.get(w, b)) | (F.get(w, a + 1) != F.get(w, b + 1)) | (F.get(w, a + 2) != F.get(w, b + 2))), F.lit(False))

    return F.size(F.filter(packed, differs)) > 0


def _covered(positions: Column) -> Column:
    """Words in three-word windows that start at the given ascending positions."""
    return F.coalesce(
        F.aggregate(
            positions,
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).cast("bigint").alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3).cast("bigint"), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        ),
        F.lit(0).cast("bigint"),
    )


def features(df: DataFrame, text: str = "text", name: str = "_q") -> DataFrame:
    """df's columns, and a struct (its name is given) of the measures that the rules use.

    Null, empty and blank texts have no words and zero in every measure.
    """
    mask = F.lit((1 << POSITION_BITS) - 1)
    of_text, of_words, of_lines, of_keys, of_again, of_stops = fresh(df, "t", "w", "l", "k", "a", "s")
    # each step is a projection of its own, so that no array is built twice
    t = df.select("*", F.coalesce(col(text), F.lit("")).alias(of_text))
    t = t.select("*", words(F.col(of_text)).alias(of_words), F.filter(F.split(of_text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(of_lines))
    w, lines = F.col(of_words), F.col(of_lines)
    n = F.size(w)
    spans = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    packed = F.transform(spans, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(~((1 << POSITION_BITS) - 1)).bitwiseOR(i.cast("bigint")))
    t = t.select("*", F.sort_array(packed).alias(of_keys))
    k = F.col(of_keys)

    def again(x, j):
        near = lambda y: F.coalesce(F.shiftright(x.bitwiseXOR(y), POSITION_BITS) == 0, F.lit(False))
        return near(F.get(k, j - 1)) | near(F.get(k, j + 1))

    stop = F.filter(F.transform(w, F.lower), lambda x: x.isin(STOP_WORDS))
    t = t.select("*", F.filter(k, again).alias(of_again), stop.alias(of_stops))
    twice, stops = F.col(of_again), F.col(of_stops)
    # the exact way for texts beyond the packing or with a hash in common: sort the words themselves
    long_keys = F.sort_array(F.transform(spans, lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.cast("bigint").alias("i"))))

    def exact(s):
        def equal(x, y):
            return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

        hit = F.filter(s, lambda x, j: equal(x, F.get(s, j - 1)) | equal(x, F.get(s, j + 1)))
        return _covered(F.sort_array(F.transform(hit, lambda x: x["i"])))

    slow = F.element_at(F.transform(F.array(long_keys), exact), 1)
    fast = _covered(F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(mask))))
    repeat = (
        F.when(F.size(twice) == 0, F.when(n < (1 << POSITION_BITS), F.lit(0).cast("bigint")).otherwise(slow))
        .when((n >= (1 << POSITION_BITS)) | _any_collision(w, twice), slow)
        .otherwise(fast)
    )
    q = F.struct(
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(of_text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.size(lines).cast("bigint").alias("n_lines"),
        repeat.alias("n_repeat_words"),
        F.size(F.array_distinct(stops)).cast("bigint").alias("n_stop_words"),
        F.size(stops).cast("bigint").alias("n_stops"),
    )
    return t.select(*columns(df), q.alias(name))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def verdict(q: Column, thresholds=THRESHOLDS) -> Column:
    """True if the measures in q pass every row of the table."""
    value = {
        "n_words": q["n_words"],
        "mean_word_chars": _ratio(q["word_chars"], q["n_words"]),
        "symbol_ratio": _ratio(q["n_symbols"], q["n_words"]),
        "n_stop_words": q["n_stop_words"],
        "stop_word_ratio": _ratio(q["n_stops"], q["n_words"]),
        "dup_line_ratio": _ratio(q["n_dup_lines"], q["n_lines"]),
        "repeat_word_ratio": _ratio(q["n_repeat_words"], q["n_words"]),
    }
    ok = F.lit(True)
    for _, feature, lowest, highest in thresholds:
        if lowest is not None:
            ok = ok & (value[feature] >= lowest)
        if highest is not None:
            ok = ok & (value[feature] <= highest)
    return ok


def _judged(df: DataFrame, text: str, thresholds, names) -> DataFrame:
    measures, failed, kept = names
    out = features(df, text, measures)
    q = F.col(measures)
    base = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    return out.select("*", base.alias(failed), (~base & verdict(q, thresholds)).alias(kept))


def quality(df: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """One row for each row of df: its columns, `_q` with the measures, base_failed and kept.

    Null and empty texts fail.  Repeated rows are judged alike; other columns are passed through, but one
    that is named as a column that is made here is replaced by it.
    """
    names = ("_q", "base_failed", "kept")
    return _judged(df.select(*[col(c) for c in df.columns if c.lower() not in names]), text, thresholds, names)


def keep_good(df: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows of df that pass; their columns are unchanged, whatever their names."""
    names = fresh(df, "q", "base_failed", "kept", "ok")
    judged = _judged(df, text, thresholds, names[:3])
    # the id is a barrier: without it the filter would be pushed below the projections, with all of them copied into it
    judged = judged.withColumn(names[3], F.col(names[2]) & (F.monotonically_increasing_id() >= 0))
    return judged.where(F.col(names[3])).select(*columns(df))
