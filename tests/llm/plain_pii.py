"""The pseudonyms of llm.pii once more in plain Python, value by value; the forms are the operator's, as text."""
import hashlib
from datetime import date, timedelta

import regex

from snaptree.llm import pii

DIGITS, LOW, UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def feistel(values, radices, tweak, key):
    h = len(values) // 2
    a, b, ra, rb = list(values[:h]), list(values[h:]), radices[:h], radices[h:]
    for i in range(pii.ROUNDS):
        own, rad, other = (a, ra, b) if i % 2 == 0 else (b, rb, a)
        half = ",".join(map(str, other))
        if len(other) >= pii.LONG:
            half = hashlib.sha256(half.encode()).hexdigest()
        for p in range(len(own)):
            drawn = int(hashlib.sha256("|".join([key, tweak, str(i), str(p), half]).encode()).hexdigest()[:8], 16)
            own[p] = (own[p] + drawn) % rad[p]
    return a + b


def symbols(s, tweak, key, alphabets):
    sets = [next((a for a in alphabets if c in a), c) for c in s]
    new = feistel([a.index(c) for a, c in zip(sets, s, strict=True)], [len(a) for a in sets], tweak, key)
    return "".join(a[i] for a, i in zip(sets, new, strict=True))


def fill(form, new, wanted):
    new = iter(new)
    return "".join(next(new) if c in wanted else c for c in form)


def luhn_check(body):
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def is_card(digits):
    return 13 <= len(digits) <= 19 and set(digits) != {"0"} and luhn_check(digits[:-1]) == digits[-1]


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def other_day(y, m, d, key):
    try:
        n = (date(y, m, d) - date(1900, 1, 1)).days
    except ValueError:
        return None
    if not 0 <= n < pii.DAYS:
        return None
    rows, cols = pii.DAY_RADICES
    for step in range(pii.WALK):
        if step == 0 or n >= pii.DAYS:
            a, b = feistel([n // cols, n % cols], [rows, cols], "date", key)
            n = a * cols + b
    return date(1900, 1, 1) + timedelta(n)


def parts(m):
    """(is a card, text) of what a run of digits is cut into."""
    if is_card("".join(filter(str.isdigit, m))):
        return [(True, m)]
    groups = regex.findall("[ -]?[0-9]+", m)

    def best(i):
        """(length is not 16, groups) of the card that starts at group i."""
        found = [(len(d) != 16, -k) for k in range(1, min(19, len(groups) - i) + 1) if is_card(d := "".join(c for g in groups[i : i + k] for c in g if c.isdigit()))]
        return min(found, default=None)

    starts, out, at = [best(i) for i in range(len(groups))], [], 0
    for i, own in enumerate(starts):
        if i >= at and own and not (own[0] and any(s and not s[0] for s in starts[i + 1 : i - own[1]])):
            out += [(False, "".join(groups[at:i])), (True, "".join(groups[i : i - own[1]]))]
            at = i - own[1]
    return [*out, (False, "".join(groups[at:]))]


def pseudonym(m, key):
    own = next((kind for kind, form in pii.FORMS if regex.fullmatch(r"[ -]?[0-9]+(?:[ -][0-9]+)*+" if kind == "card" else form, m)), None)
    # a run of digits that is no valid card may still have a later form
    if own == "card" and not is_card("".join(filter(str.isdigit, m))):
        own = next((kind for kind, form in pii.FORMS if kind not in ("card",) and regex.fullmatch(form, m)), None)
    letters = (DIGITS, LOW, UP)
    digits = "".join(c for c in m if c in DIGITS)
    hexed = lambda v: symbols(v, "hex", key, (DIGITS + ("ABCDEF" if set(v) & set("ABCDEF") else "abcdef"),))
    if own == "email":
        at = m.index("@")
        return symbols(m[:at], "text", key, letters) + m[at:]
    if own == "named":
        head = regex.match("[^=:]*[=:][ \t]*[\"']?", m)[0]
        tail = regex.search("[\"']?$", m)[0]
        value = m[len(head) : len(m) - len(tail)]
        return head + (hexed(value) if regex.fullmatch("[0-9a-f]+|[0-9A-F]+", value) else symbols(value, "text", key, letters)) + tail
    if own == "access":
        return m[:4] + symbols(m[4:], "text", key, letters)
    if own == "ipv4":
        octets = [int(x) for x in m.split(".")]
        return ".".join(map(str, feistel(octets, [256] * 4, "ipv4", key))) if max(octets) < 256 else m
    if own == "iso_date":
        d = other_day(*map(int, m.split("-")), key)
        return d.isoformat() if d else m
    if own == "day_date":
        a, b, y = int(m[:2]), int(m[3:5]), int(m[6:])
        if d := other_day(y, b, a, key):
            return d.strftime(f"%d{m[2]}%m{m[2]}") + f"{d.year:04}"
        if d := other_day(y, a, b, key):
            return d.strftime(f"%m{m[2]}%d{m[2]}") + f"{d.year:04}"
        return m
    if own == "ssn":
        area, group, serial = map(int, m.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return m
        a, g, s = feistel([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], "ssn", key)
        return f"{a + 1 + (a >= 665):03}-{g + 1:02}-{s + 1:04}"
    if own == "phone":
        if not 7 <= len(digits) <= 15:
            return m
        country = regex.match(r"\+1(?=[ .(-]|[0-9]{10}$)|\+[0-9]{1,3}|", m)[0].lstrip("+")
        return fill(m, country + symbols(digits[len(country) :], "phone", key, (DIGITS,)), DIGITS)
    if own == "card":
        body = symbols(digits[:-1], "card", key, (DIGITS,))
        return fill(m, body + luhn_check(body), DIGITS)
    if own == "iban":
        compact = m.replace(" ", "")
        if mod97(compact[4:] + compact[:4]) != 1:
            return m
        new = symbols(compact[4:], "iban", key, (DIGITS, UP))
        return fill(m, compact[:2] + f"{98 - mod97(new + compact[:2] + '00'):02}" + new, DIGITS + UP)
    return hexed(m) if own == "hex" else m


def replaced(text, key):
    """(values that were changed, text)."""
    if text is None:
        return 0, None
    card = next(form for kind, form in pii.FORMS if kind == "card")
    n = 0

    def change(m):
        nonlocal n
        new = pseudonym(m, key)
        n += new != m
        return new

    def whole(match):
        m = match[0]
        if not regex.fullmatch(card, m):
            return change(m)
        cut = parts(m)
        if not any(c or regex.search(pii.REST, t) for c, t in cut):
            return change(m)
        return "".join(change(t) if c else regex.sub(pii.REST, lambda x: change(x[0]), t) for c, t in cut)

    out = regex.sub(pii.PATTERN, whole, text)
    return n, out
