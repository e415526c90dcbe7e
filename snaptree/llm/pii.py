"""Personal data replaced by format-preserving pseudonyms, in Spark SQL functions alone.

A value is found by its form, validated (check digits, calendar, ranges), and permuted within
its format by a keyed Feistel network over mixed radices: the halves of its symbols are added
to by turns, each symbol modulo its own radix, with amounts drawn from SHA-256 of the key, the
round and the other half.  So a card number stays a valid card number, a date a date and an
address an address; equal values get equal pseudonyms in all documents, whatever separators
they are written with, and different values different ones.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, columns

#: Symbols of a half from which the network draws from the half's digest, so that its cost does not grow with the square.
LONG = 129
#: Rounds of the network; steps of a walk that ends in the calendar (each step ends it with probability 0.998).
ROUNDS, WALK = 8, 12
#: Spark setting that holds the key; there is no other default, as a published key can be undone by anyone.
KEY_SETTING = "spark.snaptree.pii.key"

_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Dotted forms that a run of digits stops before.
_DOTTED = r"(?:[0-9]{1,3}\.){3}[0-9]|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{3}\.[0-9]{3}[. -][0-9]{4}|[0-9]{3}[ -][0-9]{3}\.[0-9]{4}"
#: Forms of each kind; the first that fits counts (fixed values).  A card's form is a whole run of digits, see _run.
FORMS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("named", r"(?<![\p{L}\p{N}])(?i:password|passwd|pwd|secret|token|api[_-]?key)[ \t]*[=:][ \t]*(?:\"[^\"\s]{4,}+\"|'[^'\s]{4,}+'|[A-Za-z0-9_+/=.-]{4,}+)"),
    ("access", _EDGE + r"(?:AKIA|ASIA)[0-9A-Z]{12,}+" + _END),
    ("ipv4", r"(?<![\p{L}\p{N}.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}]|\.[0-9])"),
    ("iso_date", r"(?<![\p{L}\p{N}-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\p{L}\p{N}]|-[0-9])"),
    ("day_date", r"(?<![\p{L}\p{N}./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![\p{L}\p{N}])"),
    ("ssn", r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])"),
    ("phone", r"(?<![\p{L}\p{N}+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}" + _END),
    ("phone", r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}" + _END),
    ("phone", _EDGE + r"(?:\([0-9]{3}\) ?|[0-9]{3}[. -])[0-9]{3}[. -][0-9]{4}" + _END),
    ("card", _EDGE + r"(?=[0-9](?:[ -]?[0-9]){12})[0-9]++" + _END + rf"(?:[ -](?!{_DOTTED})[0-9]++{_END})*+"),
    ("iban", _EDGE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END),
    ("hex", _EDGE + r"(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)" + _END),
)
PATTERN = "|".join(form for _, form in FORMS)
#: All forms but the card's, for what a run of digits holds besides cards.
REST = "|".join(form for kind, form in FORMS if kind != "card")
_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Days of 1900-01-01 to 2099-12-31, and two radices whose product is little more.
DAYS, DAY_RADICES = 73049, (270, 271)


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(values: Column, radices: Column, tweak: str, key: Column) -> Column:
    """A keyed permutation of the arrays of ints below the given radices."""

    def halves(x):
        n = F.size(x["v"])
        h = F.floor(n / 2).cast("int")
        part = lambda a: (F.slice(a, 1, h), F.slice(a, h + 1, n - h))
        a, b = part(x["v"])

        def drawn(half, i, p):
            return F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(tweak), i.cast("string"), p.cast("string"), half), 256), 1, 8), 16, 10).cast("bigint")

        def add(own, skip, half, i):
            return F.transform(own, lambda v, p: F.pmod(v.cast("bigint") + drawn(half, i, p), F.get(x["r"], p + skip).cast("bigint")).cast("int"))

        def step(s, j):
            """Of the two steps of a round the first writes the other half out, once for all symbols."""
            i = F.floor(j / 2).cast("int")
            other = F.when(i % 2 == 0, s["b"]).otherwise(s["a"])
            joined = F.array_join(other.cast("array<string>"), ",")
            half = F.when(j % 2 == 1, s["h"]).when(F.size(other) >= LONG, F.sha2(joined, 256)).otherwise(joined)
            turn = lambda n: (j % 2 == 1) & (i % 2 == n)
            return F.struct(F.when(turn(0), add(s["a"], F.lit(0), s["h"], i)).otherwise(s["a"]).alias("a"), F.when(turn(1), add(s["b"], h, s["h"], i)).otherwise(s["b"]).alias("b"), half.alias("h"))

        start = F.struct(a.alias("a"), b.alias("b"), F.lit("").alias("h"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), start, step, lambda s: F.concat(s["a"], s["b"]))

    return _let(F.struct(values.alias("v"), radices.alias("r")), halves)


def _symbols(s: Column, tweak: str, key: Column, alphabets) -> Column:
    """s with each character permuted within the first alphabet that has it; others stay."""
    place = lambda c: [F.instr(F.lit(a), c) for a in alphabets]

    def classed(c):
        at = place(c)
        value = reduce(lambda acc, x: F.when(x > 0, x - 1).otherwise(acc), reversed(at), F.lit(0))
        radix = reduce(lambda acc, x: F.when(x[1] > 0, F.lit(len(x[0]))).otherwise(acc), reversed(list(zip(alphabets, at, strict=True))), F.lit(1))
        which = reduce(lambda acc, x: F.when(x[1] > 0, F.lit(x[0])).otherwise(acc), reversed(list(zip(alphabets, at, strict=True))), c)
        return F.struct(value.cast("int").alias("v"), radix.cast("int").alias("r"), which.alias("w"))

    def run(x):
        new = feistel(F.transform(x, lambda y: y["v"]), F.transform(x, lambda y: y["r"]), tweak, key)
        return F.array_join(F.transform(F.arrays_zip(new.alias("n"), x.alias("x")), lambda z: F.substr(z["x"]["w"], z["n"] + 1, F.lit(1))), "")

    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.when(F.length(s) > 0, _let(F.transform(chars, classed), run)).otherwise(s)


def _fill(form: Column, digits: Column, wanted: str = "[0-9]") -> Column:
    """form with its digits (or other wanted characters) replaced by the given ones, in order."""
    step = lambda s, c: F.when(c.rlike(wanted), F.struct(F.concat(s["t"], F.substr(digits, s["k"], F.lit(1))).alias("t"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["k"].alias("k")))
    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("k")), step, lambda s: s["t"])


def _luhn_sum(digits: Column) -> Column:
    """Sum in which each second digit from the right, the last one first, is doubled."""
    return F.aggregate(
        F.reverse(F.split(digits, "")), F.struct(F.lit(0).alias("t"), F.lit(2).alias("m")),
        lambda s, c: F.struct((s["t"] + F.when(c == "", F.lit(0)).otherwise((lambda d: d - F.when(d > 9, F.lit(9)).otherwise(F.lit(0)))(F.coalesce(c.try_cast("int"), F.lit(0)) * s["m"]))).alias("t"), F.when(c == "", s["m"]).otherwise(F.lit(3) - s["m"]).alias("m")),
        lambda s: s["t"],
    )


def _mod97(s: Column) -> Column:
    """The number that s spells (A is 10 ... Z is 35) modulo 97."""
    return F.aggregate(F.split(s, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).when(c.rlike("[0-9]"), (acc * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))


def _date(y: Column, m: Column, d: Column) -> Column:
    """Days since 1900-01-01, or null if there is no such day or it is outside 1900-2099."""
    at = F.datediff(F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-MM-dd")).cast("date"), F.lit("1900-01-01").cast("date"))
    return F.when((at >= 0) & (at < DAYS), at)


def _other_day(days: Column, key: Column) -> Column:
    a, b = DAY_RADICES
    radices = F.array(F.lit(a), F.lit(b))

    def step(x, i):
        once = _let(feistel(F.array(F.floor(x / b).cast("int"), (x % b).cast("int")), radices, "date", key), lambda y: (F.get(y, F.lit(0)) * b + F.get(y, F.lit(1))).cast("int"))
        return F.when((i == 0) | (x >= DAYS), once).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(WALK - 1)), days.cast("int"), step)


def _is_card(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & digits.rlike("[1-9]") & (_luhn_sum(F.substr(digits, F.lit(1), F.length(digits) - 1)) % 10 == F.pmod(-F.substr(digits, F.length(digits), F.lit(1)).cast("int"), F.lit(10)))


def _parts(m: Column) -> Column:
    """A run of digits cut into its cards and what lies between them, array of struct card, t.

    The run is one card if it is valid as a whole; else cards are sought between its separators from the left, those of
    16 digits first: another length counts only if no valid 16 digits start within it.
    """
    joined = lambda p, i, k: F.array_join(F.slice(p, i + 1, k), "")
    few = lambda p, i, k: F.array_join(F.transform(F.sequence(i, i + k - 1), lambda j: F.get(p, j)), "")  # noqa: E731  # slice copies all of p

    def at(p, i):
        """Groups of the cards that start at group i, those of 16 digits first."""
        sizes = F.transform(F.sequence(F.lit(1), F.least(F.lit(19), F.size(p) - i)), lambda k: F.struct(k.alias("k"), F.regexp_replace(few(p, i, k), "[ -]", "").alias("d")))
        good = F.filter(F.filter(sizes, lambda c: F.length(c["d"]).between(13, 19)), lambda c: _is_card(c["d"]))
        return F.sort_array(F.transform(good, lambda c: F.struct((F.length(c["d"]) != 16).alias("odd"), (-c["k"]).alias("k"))))

    def cut(x):
        p, found = x["p"], x["f"]

        def step(s, i):
            best = F.get(F.get(found, i), F.lit(0))
            k = -best["k"]
            later = F.exists(F.sequence(i, i + k - 1), lambda j: F.coalesce((j > i) & ~F.get(F.get(found, j), F.lit(0))["odd"], F.lit(False)))
            take = (i >= s["next"]) & best.isNotNull() & (~best["odd"] | ~later)
            gap = F.struct(F.lit(False).alias("card"), joined(p, s["next"], i - s["next"]).alias("t"))
            card = F.struct(F.lit(True).alias("card"), few(p, i, k).alias("t"))
            return F.when(F.coalesce(take, F.lit(False)), F.struct((i + k).alias("next"), F.concat(s["out"], F.array(gap, card)).alias("out"))).otherwise(s)

        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<card:boolean,t:string>>").alias("out"))
        end = lambda s: F.concat(s["out"], F.array(F.struct(F.lit(False).alias("card"), joined(p, s["next"], F.size(p) - s["next"]).alias("t"))))
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), start, step, end)

    pieces = F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0))
    searched = _let(pieces, lambda p: F.struct(p.alias("p"), F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: at(p, i)).alias("f")))
    return F.when(_is_card(F.regexp_replace(m, "[^0-9]", "")), F.array(F.struct(F.lit(True).alias("card"), m.alias("t")))).otherwise(_let(searched, cut))


def _pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of a match; matches that are not valid stay as they are."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    is_ = {}
    for kind, form in FORMS:
        form = r"[ -]?[0-9]+(?:[ -][0-9]+)*+" if kind == "card" else form
        own = m.rlike(rf"\A(?:{form})\z")
        is_[kind] = is_[kind] | own if kind in is_ else own
    letters = (_DIGITS, _LOW, _UP)

    at = F.instr(m, "@")
    email = F.concat(_symbols(F.substr(m, F.lit(1), at - 1), "text", key, letters), F.substr(m, at))

    head = F.regexp_extract(m, r"\A([^=:]*[=:][ \t]*[\"']?)", 1)
    value = F.regexp_extract(m, r"\A[^=:]*[=:][ \t]*[\"']?(.*?)[\"']?\z", 1)
    tail = F.regexp_extract(m, r"([\"']?)\z", 1)
    named = F.concat(head, F.when(value.rlike(r"\A[0-9a-f]+\z"), _symbols(value, "hex", key, ("0123456789abcdef",))).when(value.rlike(r"\A[0-9A-F]+\z"), _symbols(value, "hex", key, ("0123456789ABCDEF",))).otherwise(_symbols(value, "text", key, letters)), tail)

    access = F.concat(F.substr(m, F.lit(1), F.lit(4)), _symbols(F.substr(m, F.lit(5)), "text", key, letters))
    hexed = F.when(m.rlike("[A-F]"), _symbols(m, "hex", key, ("0123456789ABCDEF",))).otherwise(_symbols(m, "hex", key, ("0123456789abcdef",)))

    octets = F.transform(F.split(m, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(256)))
    ip = F.when(F.forall(octets, lambda x: x < 256), F.array_join(feistel(octets, F.array(*[F.lit(256)] * 4), "ipv4", key).cast("array<string>"), ".")).otherwise(m)

    part = lambda a, n: F.substr(m, F.lit(a), F.lit(n))
    day = lambda days, form: F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), days), form)
    iso = _let(_date(part(1, 4), part(6, 2), part(9, 2)), lambda x: F.when(x.isNotNull(), day(_other_day(x, key), "yyyy-MM-dd")).otherwise(m))
    sep = part(3, 1)
    first = _let(_date(part(7, 4), part(4, 2), part(1, 2)), lambda x: F.when(x.isNotNull(), _let(day(_other_day(x, key), "ddMMyyyy"), lambda t: F.concat(F.substr(t, F.lit(1), F.lit(2)), sep, F.substr(t, F.lit(3), F.lit(2)), sep, F.substr(t, F.lit(5), F.lit(4))))))
    second = _let(_date(part(7, 4), part(1, 2), part(4, 2)), lambda x: F.when(x.isNotNull(), _let(day(_other_day(x, key), "MMddyyyy"), lambda t: F.concat(F.substr(t, F.lit(1), F.lit(2)), sep, F.substr(t, F.lit(3), F.lit(2)), sep, F.substr(t, F.lit(5), F.lit(4))))))

    num = lambda a, n: F.coalesce(part(a, n).try_cast("int"), F.lit(0))
    area, group, serial = num(1, 3), num(5, 2), num(8, 4)
    # areas 001-899 without 666 are 898 values
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    ssn_ok = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    ssn_new = _let(feistel(F.array(index, group - 1, serial - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key), lambda y: F.concat_ws("-", F.lpad((F.get(y, F.lit(0)) + F.when(F.get(y, F.lit(0)) >= 665, F.lit(2)).otherwise(F.lit(1))).cast("string"), 3, "0"), F.lpad((F.get(y, F.lit(1)) + 1).cast("string"), 2, "0"), F.lpad((F.get(y, F.lit(2)) + 1).cast("string"), 4, "0")))
    ssn = F.when(ssn_ok, ssn_new).otherwise(m)

    country = F.regexp_replace(F.regexp_extract(m, r"\A(\+1(?=[ .(-]|[0-9]{10}\z)|\+[0-9]{1,3}|)", 1), r"\+", "")
    rest = F.substr(digits, F.length(country) + 1)
    phone = F.when(F.length(digits).between(7, 15), _fill(m, F.concat(country, _symbols(rest, "phone", key, (_DIGITS,))))).otherwise(m)

    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    card = _let(_symbols(body, "card", key, (_DIGITS,)), lambda new: _fill(m, F.concat(new, F.pmod(-_luhn_sum(new), F.lit(10)).cast("string"))))

    compact = F.regexp_replace(m, " ", "")
    land, account = F.substr(compact, F.lit(1), F.lit(2)), F.substr(compact, F.lit(5))
    iban_ok = _mod97(F.concat(account, F.substr(compact, F.lit(1), F.lit(4)))) == 1

    def iban_of(new):
        check = F.lpad((98 - _mod97(F.concat(new, land, F.lit("00")))).cast("string"), 2, "0")
        return _fill(m, F.concat(land, check, new), "[0-9A-Z]")

    iban = F.when(iban_ok, _let(_symbols(account, "iban", key, (_DIGITS, _UP)), iban_of)).otherwise(m)

    return (
        F.when(is_["email"], email).when(is_["named"], named).when(is_["access"], access).when(is_["ipv4"], ip).when(is_["iso_date"], iso)
        .when(is_["day_date"], F.coalesce(first, second, m)).when(is_["ssn"], ssn).when(is_["phone"], phone).when(is_["card"] & _is_card(digits), card).when(is_["iban"], iban).when(is_["hex"], hexed).otherwise(m)
    )


def _token(hit: bool, t: Column) -> Column:
    return F.array(F.struct(F.lit(hit).alias("hit"), t.alias("t")))


def _tokens(text: Column) -> Column:
    """text cut into its matches and the parts between them, array of struct hit, t; a run of digits is cut further."""
    card = next(form for kind, form in FORMS if kind == "card")
    cut = lambda t, form: F.struct(F.split(t, form).alias("p"), F.regexp_extract_all(t, F.lit(form), F.lit(0)).alias("f"))
    woven = lambda s, hit: F.flatten(F.transform(s["p"], lambda x, i: F.when(F.get(s["f"], i).isNull(), _token(False, x)).otherwise(F.concat(_token(False, x), hit(F.get(s["f"], i))))))

    def inside(m):
        found = F.flatten(F.transform(_parts(m), lambda x: F.when(x["card"], _token(True, x["t"])).otherwise(woven(cut(x["t"], REST), lambda y: _token(True, y)))))
        return _let(found, lambda x: F.when(F.exists(x, lambda y: y["hit"]), x).otherwise(_token(True, m)))

    is_run = lambda m: m.rlike(rf"\A(?:{card})\z")
    return _let(cut(text, PATTERN), lambda s: woven(s, lambda m: F.when(is_run(m), inside(m)).otherwise(_token(True, m))))


def _replaced(text: Column, key: Column) -> Column:
    """struct n (values that were changed), text (with all of them replaced; parts between matches are copied)."""
    parts = F.transform(_tokens(text), lambda x: F.struct(x["t"].alias("t"), F.when(x["hit"], _pseudonym(x["t"], key)).otherwise(x["t"]).alias("new")))
    whole = _let(parts, lambda p: F.struct(F.size(F.filter(p, lambda x: x["t"] != x["new"])).cast("bigint").alias("n"), F.array_join(F.transform(p, lambda x: x["new"]), "").alias("text")))
    return F.when(text.rlike("[0-9@=:]") & text.rlike(PATTERN), whole).otherwise(F.struct(F.lit(0).cast("bigint").alias("n"), text.alias("text")))


def pseudonymised(text: Column, key: Column) -> Column:
    """text with all personal data replaced."""
    return _replaced(text, key)["text"]


def key_of(df: DataFrame, key: str | None) -> Column:
    """The given key or that of the session; without one nothing is done."""
    found = key or df.sparkSession.conf.get(KEY_SETTING, None)
    if not found:
        raise ValueError(f"pseudonyms need a key: give one or set {KEY_SETTING}")
    return F.lit(found)


def pseudonymise(df: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """df with personal data in its text column replaced by pseudonyms; all rows and other columns stay.

    Emails (local part), named secrets and access keys, hexadecimal secrets, IPv4 addresses, dates of 1900-2099,
    social security, phone, card (Luhn) and account (IBAN) numbers.  Secrets have no greatest length.  A card is also
    found among other digits beside it; so digits in a row of numbers may pass for one.  What has the form but is not valid stays.
    Null and empty texts stay null and empty; repeated rows are changed alike.  key: see key_of().
    """
    changed = pseudonymised(col(text), key_of(df, key)).alias(text)
    return df.select(*[changed if name == text else c for name, c in zip(df.columns, columns(df), strict=True)])


def report(df: DataFrame, key: str = "doc_id", text: str = "text", secret: str | None = None) -> DataFrame:
    """key, n_found and the pseudonymised text of each row of df; n_found: values that were replaced.

    A null text stays null with n_found 0, as an empty one does; repeated rows and null keys each get their own row;
    further columns are left out.  secret: see key_of().
    """
    done = df.select(col(key), _replaced(col(text), key_of(df, secret)).alias("r" if key != "r" else "r_"))
    r = F.col(done.columns[1])
    return done.select(col(key), F.coalesce(r["n"], F.lit(0).cast("bigint")).alias("n_found"), r["text"].alias("text"))
