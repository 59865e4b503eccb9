"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Method. One pattern finds e-mail addresses, payment cards, telephone numbers, IP addresses, social security
numbers, dates and secrets. Numbers and dates are validated (Luhn digit, number of digits, areas, octets, calendar) and
permuted by a keyed Feistel network within their format: a card stays a card with its Luhn digit, a date a date of the same
400 years, an address of a host one, and a telephone number keeps its country code and the validity of its area and exchange.
Equal values get equal pseudonyms in every document, however they are spaced. Text around a value is not touched. Whoever
holds the key can invert numbers and dates; e-mail addresses, IPv6 addresses (by their spelling) and secrets are replaced by keyed
digests, key ids and IPv6 addresses by 64 and 96 bits, others by 128 or more. The value behind a name such as ``secret`` counts if it
is assigned or quoted; after a colon or a spaced sign a plain word is prose and stays.

The pattern marks what it finds in one pass; all else works on the marked parts. The key enters plans only as a digest behind
the word ``pseudonym-key``, which ``spark.sql.redaction.string.regex`` can hide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import unused

ROUNDS = 8

# What each kind looks like. A kind's pattern is tried in this order.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
NAMES = r"passwords?|passwd|pwd|passphrase|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth[_ -]?key"
NAMED = rf"(?i:(?:[a-z]++[_-])?(?:{NAMES}))"
#: How keys of well-known services begin, and what follows.
KEYS = {"A[KS]IA": "[0-9A-Z]{16}", "gh[oprsu]_": "[0-9A-Za-z]{36,}+", "github_pat_": "[0-9A-Za-z_]{22,}+", "glpat-": "[0-9A-Za-z_-]{20,}+", "sk-": "(?=[A-Za-z_-]*[0-9])[0-9A-Za-z_-]{20,}+", "xox[abprs]-": "[0-9A-Za-z-]{10,}+", "AIza": "[0-9A-Za-z_-]{35}"}
#: The value behind a name: after an assignment any; after a colon or spaced sign, as prose has them, one that is no plain word.
RUN = r"[^\s\"'\x01]{6,}+"
MIXED = r"(?=[^\s\"'\x01]*?(?:[0-9]|[a-z][A-Z]|[!#$%&*+=@^~][0-9A-Za-z]))"
QUOTED = r"(?:\"[^\"\n\x01]{6,}+(?=\")|'[^'\n\x01]{6,}+(?='))"
SECRETS = [
    rf"(?<![A-Za-z]){NAMED}(?:[\"']? ?=|[\"'] ?:) ?{QUOTED}", rf"(?<![A-Za-z]){NAMED}(?:[\"']?=|[\"'] ?:) ?[\"']?{RUN}", rf"(?<![A-Za-z]){NAMED} ?[=:] ?[\"']?{MIXED}{RUN}",
    r"(?<![A-Za-z])(?i:bearer) (?=[A-Za-z._~+/-]*[0-9])[0-9A-Za-z._~+/-]{16,}+=*", *(rf"(?<![0-9A-Za-z]){k}{v}(?![0-9A-Za-z])" for k, v in KEYS.items()),
]
#: What stands before a number of goods or papers, and before a number of a version.
COUNTED = r"(?<!(?i:order|invoice|ticket|case|item|serial|tracking|parcel|account|reference|ref\.?)(?: (?:no\.?|nr\.?|number|id))?[:#]? #?)"
VERSION = r"(?<!(?i:versions?|releases?|firmware|build|revision|rev\.?|ver\.?|v\.?) )"
# an address's local part may hold any letters; marks before it stay
LOCAL = r"\p{L}\p{M}\p{N}._%+'-"
PATTERNS = {
    "email": rf"(?<![{LOCAL}])[._%+'-]*+[\p{{L}}\p{{N}}][{LOCAL}]*+@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)+",
    # a name, a sign and the whole value behind them, or a key that is told by its form
    "secret": "|".join(SECRETS),
    "phone": rf"(?<![0-9A-Za-z_+])\+[0-9]{{1,3}}(?:[ .-]?\([0-9]{{1,4}}\)|[ .-]?[0-9]{{2,4}}){{1,2}}(?:[ .-]?[0-9]{{2,4}}){{1,4}}(?![0-9])|(?<![0-9A-Za-z_.+-])\([0-9]{{3}}\) ?[0-9]{{3}}[ .-][0-9]{{4}}(?![0-9A-Za-z_-])|(?<![0-9A-Za-z_.+-])(?<![0-9] ){COUNTED}(?:[2-9][0-9]{{2}} [0-9]{{3}} [0-9]{{4}}|[0-9]{{3}}([.-])[0-9]{{3}}\1[0-9]{{4}})(?![0-9A-Za-z_-]|[ .][0-9])|(?<=(?<![A-Za-z])(?i:tel):)[0-9]{{7,12}}(?![0-9])",
    "ssn": rf"(?<![0-9A-Za-z_-])(?:[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}|(?<![0-9] ){COUNTED}[0-9]{{3}} [0-9]{{2}} [0-9]{{4}}(?! [0-9]))(?![0-9A-Za-z_-])",
    "date": r"(?<![0-9A-Za-z_-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9A-Za-z_/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])|(?<![0-9A-Za-z_.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9A-Za-z_]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{5})(?![0-9])",
    "ip": rf"(?<![0-9A-Za-z_.]){VERSION}(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])|(?<![0-9A-Za-z_:.])(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|(?:[0-9A-Fa-f]{{1,4}}:){{1,6}}(?::[0-9A-Fa-f]{{1,4}}){{1,6}})(?![0-9A-Za-z_:])",
}
KINDS = list(PATTERNS)
#: All patterns as one; groups are numbered through, so that its back references hold.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these holds nothing to find.
MAY = rf"[0-9@]|(?i:{NAMES})[\"']? ?[=:]|{'|'.join(KEYS)}"
#: Marks a found part's beginning (m) and end (e), and itself where a text holds it (n).
MARK = "\x01"
#: Dates are permuted over the 400 years from here on, a whole number of days of the calendar's cycle (189 * 773).
EPOCH, CYCLE = "1800-01-01", (189, 773)


def plan_key(key: str) -> str:
    """What stands for a key in plans."""
    return "pseudonym-key:" + hashlib.sha256(key.encode()).hexdigest()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, tweak: str, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of a keyed permutation of pairs (a, b) with a below size_a and b below size_b."""

    def mixed(r: Column, x: Column, size: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(f"{key}\x1f{tweak}\x1f"), r.cast("string"), F.lit("\x1f"), size.cast("string"), F.lit("\x1f"), x.cast("string")), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)

    def step(s: Column, r: Column) -> Column:
        odd = r % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(s["a"] + mixed(r, s["b"], size_a), size_a)).otherwise(s["a"]).alias("a"),
            F.when(odd, s["b"]).otherwise(F.pmod(s["b"] + mixed(r, s["a"], size_b), size_b)).alias("b"),
        )

    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)
    return let(out, lambda s: body(s["a"], s["b"]))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, its last digit not doubled."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when((n - i) % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def permuted_digits(digits: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of strings of digits of each length from 2 to 36."""
    left = F.floor(F.length(digits) / 2).cast("int")
    right = F.length(digits) - left
    ten = lambda n: F.pow(F.lit(10.0), n).cast("long")
    made = lambda a, b: F.concat(F.lpad(a.cast("string"), left, "0"), F.lpad(b.cast("string"), right, "0"))
    return _feistel(F.substr(digits, F.lit(1), left), F.substr(digits, left + 1), ten(left), ten(right), key, tweak, made)


def _in_format(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced, from the first on, by ``digits``."""
    at = F.sequence(F.lit(1), F.length(text))
    char = lambda i: F.substr(text, i, F.lit(1))
    before = lambda i: F.length(digits_of(F.substr(text, F.lit(1), i)))
    return let(digits, lambda d: F.array_join(F.transform(at, lambda i: F.when(char(i).between("0", "9"), F.substr(d, before(i), F.lit(1))).otherwise(char(i))), ""))


def _card(m: Column, key: str) -> Column:
    d = digits_of(m)
    checked = lambda body: F.concat(body, F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    return _in_format(m, let(permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card"), checked))


def _country(m: Column) -> Column:
    """The country code's digits: those before the first separator, or all but ten; none without a plus sign."""
    apart = F.regexp_extract(m, r"^\+([0-9]{1,3})[ .(-]", 1)
    d = digits_of(m)
    return F.when(~m.startswith("+"), "").when(apart != "", apart).otherwise(F.substr(d, F.lit(1), F.greatest(F.length(d) - 10, F.lit(1))))


def _phone(m: Column, key: str) -> Column:
    """Ten digits: area and exchange keep whether they begin with 2 to 9; others keep whether they begin with 0."""
    code = _country(m)
    d = F.substr(digits_of(m), F.length(code) + 1)
    ten, n = F.length(d) == 10, F.length(d)
    left = F.when(ten, 3).otherwise(F.floor(n / 2)).cast("int")
    power = lambda x: F.pow(F.lit(10.0), x).cast("long")

    def half(part: Column, size: Column, first: int) -> tuple[Column, Column, Column]:
        """(value, number of values, least value) of a part whose first digit stays below ``first`` or not."""
        unit_, v = power(size - 1), part.cast("long")
        high = v >= first * unit_
        return F.when(high, v - first * unit_).otherwise(v), F.when(high, (10 - first) * unit_).otherwise(first * unit_), F.when(high, first * unit_).otherwise(F.lit(0))

    right = n - left
    la, lb = half(F.substr(d, F.lit(1), left), left, 2), half(F.substr(d, left + 1), right, 2)
    ga, gb = half(F.substr(d, F.lit(1), left), left, 1), (F.substr(d, left + 1).cast("long"), power(right), F.lit(0))
    pick = lambda x, y: F.when(ten, x).otherwise(y)
    (va, sa, oa), (vb, sb, ob) = [tuple(map(pick, x, y)) for x, y in ((la, ga), (lb, gb))]
    made = lambda a, b: F.concat(code, F.lpad((a + oa).cast("string"), left, "0"), F.lpad((b + ob).cast("string"), right, "0"))
    return _in_format(m, _feistel(va, vb, sa.cast("long"), sb.cast("long"), key, "phone", made))


def _host(m: Column) -> Column:
    """Whether an address can be a host's: its first octet is 1 to 223 and not 127."""
    first = F.split(m, r"\.")[0].cast("int")
    return (first >= 1) & (first <= 223) & (first != 127)


def _ip(m: Column, key: str) -> Column:
    o = F.split(m, r"\.")
    n = lambda i: o[i].cast("long")

    def made(a: Column, b: Column) -> Column:
        first = F.floor(a / 256) + 1
        return F.concat_ws(".", *(x.cast("string") for x in (first + (first >= 127).cast("long"), a % 256, F.floor(b / 256), b % 256)))

    four = _feistel((n(0) - 1 - (n(0) > 127).cast("long")) * 256 + n(1), n(2) * 256 + n(3), F.lit(222 * 256).cast("long"), F.lit(65536).cast("long"), key, "ip", made)
    # the longer form: a digest behind the prefix that is kept for examples
    d = _digest(F.lower(m), key, "ip")
    return F.when(m.contains(":"), F.concat_ws(":", F.lit("2001:db8"), *(F.substring(d, 4 * i + 1, 4) for i in range(6)))).otherwise(four)


def _ssn_area(m: Column) -> Column:
    return F.substr(m, F.lit(1), F.lit(3)).cast("long")


def _ssn(m: Column, key: str) -> Column:
    # valid: area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999
    area, group, serial = _ssn_area(m), F.substr(m, F.lit(5), F.lit(2)).cast("long"), F.substr(m, F.lit(8)).cast("long")

    def made(a: Column, b: Column) -> Column:
        new = F.floor(a / 99) + 1
        parts = F.lpad((new + (new >= 666).cast("long")).cast("string"), 3, "0"), F.lpad((a % 99 + 1).cast("string"), 2, "0"), F.lpad((b + 1).cast("string"), 4, "0")
        return F.when(m.contains("-"), F.concat_ws("-", *parts)).otherwise(F.concat_ws(" ", *parts))

    return _feistel((area - 1 - (area > 666).cast("long")) * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, "ssn", made)


def _day(m: Column) -> Column:
    """The date, from ISO form or, with strokes or points, from day/month/year, or else month/day/year; null if it is none of the 400 years."""
    s = F.translate(m, ".", "/")
    day = F.when(m.contains("-"), F.try_to_timestamp(m, F.lit("yyyy-MM-dd"))).otherwise(F.coalesce(F.try_to_timestamp(s, F.lit("dd/MM/yyyy")), F.try_to_timestamp(s, F.lit("MM/dd/yyyy")))).cast("date")
    at = F.datediff(day, F.lit(EPOCH).cast("date"))
    return F.when((at >= 0) & (at < CYCLE[0] * CYCLE[1]), at)


def _date(m: Column, key: str) -> Column:
    first = F.try_to_timestamp(F.translate(m, ".", "/"), F.lit("dd/MM/yyyy")).isNotNull()
    points = lambda x: F.when(m.contains("."), F.translate(x, "/", ".")).otherwise(x)

    def made(a: Column, b: Column) -> Column:
        day = F.date_add(F.lit(EPOCH).cast("date"), (a * CYCLE[1] + b).cast("int"))
        return F.when(m.contains("-"), F.date_format(day, "yyyy-MM-dd")).otherwise(points(F.when(first, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))))

    return let(_day(m).cast("long"), lambda at: _feistel(F.floor(at / CYCLE[1]), at % CYCLE[1], F.lit(CYCLE[0]).cast("long"), F.lit(CYCLE[1]).cast("long"), key, "date", made))


def _digest(m: Column, key: str, kind: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}\x1f{kind}\x1f"), m), 256)


def _email(m: Column, key: str) -> Column:
    marks = F.regexp_extract(m, r"^[._%+'-]*", 0)
    return F.concat(marks, F.lit("u"), F.substring(_digest(F.lower(F.substr(m, F.length(marks) + 1)), key, "email"), 1, 32), F.lit("@mail.invalid"))


#: How a secret begins: what stays in clear.
LEAD = rf"^(?:(?i:(?:[a-z]+[_-])?(?:{NAMES}))[\"']? ?[=:] ?[\"']?|(?i:bearer) |{'|'.join(KEYS)})"


def _secret(m: Column, key: str) -> Column:
    """The value behind a name and its sign as a digest of 40 digits, whatever its length; keys of a known form keep their beginning."""
    lead = F.regexp_extract(m, LEAD, 0)
    made = F.substring(_digest(F.substr(m, F.length(lead) + 1), key, "secret"), 1, 40)
    return F.when(m.rlike("^A[KS]IA[0-9A-Z]{16}$"), F.concat(lead, F.upper(F.substring(made, 1, 16)))).otherwise(F.concat(lead, made))


def kind_of(m: Column) -> Column:
    """The kind of a found string, null if its validation fails."""
    whole = lambda k: m.rlike(f"^(?:{PATTERNS[k].replace(chr(92) + '2', chr(92) + '1').replace(chr(92) + '3', chr(92) + '2')})$")
    area, digits = _ssn_area(m), F.length(digits_of(m))
    checks = {
        "ssn": (area > 0) & (area < 900) & (area != 666) & ~m.rlike("[ -]00[ -]|[ -]0000$"),
        "date": _day(m).isNotNull(),
        "card": (luhn_sum(digits_of(m)) % 10 == 0) & digits_of(m).rlike("[1-9]"),
        "ip": _host(m),
        "phone": ~m.startswith("+") | digits.between(8, 15),
    }
    six = m.rlike("^[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]*$")
    out = F.when(six, F.when(m.rlike("[0-9]") & (F.size(F.split(m, ":+")) > 2), "ip")).when(m.rlike(LEAD), "secret").when(m.contains("@"), "email")
    for k, check in checks.items():
        out = out.when(whole(k), F.when(check, F.lit(k)))
    # digits that only what stands before them told
    return out.when(m.rlike("^[0-9]{7,12}$"), "phone")


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """What stands for a found string; the string itself if kind is null."""
    made = {"email": _email, "secret": _secret, "phone": _phone, "ssn": _ssn, "date": _date, "card": _card, "ip": _ip}
    out = F.when(kind.isNull(), m)
    for k, f in made.items():
        out = out.when(kind == k, f(m, key))
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str = "pii") -> DataFrame:
    """``docs`` with ``text`` pseudonymised and a column ``found``, the array of kinds found in it, in their order.

    Null text: stays null, ``found`` is empty. Empty, very long and repeated texts are handled alike. All other columns are
    kept as they are; a column of that name is replaced. An empty table gives an empty result.
    """
    t, key = F.col(text).cast("string"), plan_key(key)
    marked = F.regexp_replace(F.replace(t, F.lit(MARK), F.lit(MARK + "n")), F.lit(ANY), F.lit(f"{MARK}m$0{MARK}e"))
    names = docs.columns
    tag, rest = (lambda x: F.substring(x, 1, 1)), (lambda x: F.substr(x, F.lit(2)))
    none = F.array().cast("array<struct<tag:string,text:string,kind:string>>")

    def part(x: Column, i: Column) -> Column:
        first = F.struct(F.lit("e").alias("tag"), x.alias("text"), F.lit(None).cast("string").alias("kind"))
        return F.when(i == 0, first).otherwise(F.struct(tag(x).alias("tag"), rest(x).alias("text"), F.when(tag(x) == "m", kind_of(rest(x))).alias("kind")))

    parts = unused("parts", names)
    a = docs.withColumn(parts, F.when(t.rlike(MAY), F.transform(F.split(marked, MARK, -1), part)).otherwise(none))
    one = lambda x: F.when(x["kind"].isNotNull(), pseudonym(x["text"], x["kind"], key)).when(x["tag"] == "n", F.concat(F.lit(MARK), x["text"])).otherwise(x["text"])
    made = F.transform(parts, one)
    new = F.when(F.exists(parts, lambda x: x["kind"].isNotNull()), F.array_join(made, "")).otherwise(t)
    kept = [F.col(f"`{c}`") if c != text else new.alias(text) for c in names if c != found]
    kinds = F.transform(F.filter(F.coalesce(parts, none), lambda x: x["kind"].isNotNull()), lambda x: x["kind"])
    return a.select(*kept, kinds.alias(found))


def pii(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_found and the count of each kind) for each document; see ``pseudonymise``."""
    rows = pseudonymise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key)
    count = lambda k: F.size(F.filter("pii", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", "text", F.size("pii").cast("long").alias("n_found"), *map(count, KINDS))
