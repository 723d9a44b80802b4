"""Operator 4: format-preserving pseudonyms by a keyed Feistel permutation, in Spark SQL functions only.

Numbers that validate (card numbers by issuer prefix and Luhn digit, IPv4 addresses, telephone numbers, social
security numbers) and calendar dates are permuted within their own format: the value is a pair (left, right) in
Z_a x Z_b, and eight rounds add a keyed SHA-256 of one half to the other. A permutation keeps equal values equal across
documents and distinct values distinct; card numbers keep their issuer's prefix and get a fitting check digit, dates
stay dates, separators stay where they are. E-mail addresses and secrets have no number to permute: they get a keyed
digest in the same shape, of 64 bits for a local part and for a host.

A text is split at the matches of one pattern and joined again with each match replaced, so all of it is inside
one projection, without a shuffle. The key is the caller's, see `key_of`; there is no default.

What validates: telephone numbers have an exchange from 200 on, and an area from 200 on unless a +1 or a bracket marks
them (both sorts are permuted among themselves); numbers of other countries start with + and have 8 to 15 digits, of
which the country's stay. IPv4 octets are 0 to 255 without leading zeros. Dates lie in 1900-01-01 .. 2100-05-01; with
slashes they are read day first, and where only month first makes a date they are permuted among such dates. Everything
else is left alone.

Nulls: a null text stays null with 0 replacements. Empty texts, repeated rows, other columns and their names are
left as they are. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: The setting that holds the key, and the key of the queries over the synthetic tables, which has nothing to protect.
KEY = "spark.lodestar.pseudonymKey"
OPEN_KEY = "synthetic tables only"
#: Formats of what is replaced (fixed values), tried in this order.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "cloud": r"\bAKIA[0-9A-Z]{16}\b",
    "secret": r"(?i:(?<![A-Za-z0-9])(?:[A-Za-z0-9]{1,32}[_-]){0,4}(?:password|passwd|pwd|token|secret|api_?key)\b\s{0,3}[=:]\s{0,3}\"?)[^\s\"]{6,}+",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)",
    "iso": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "slash": r"(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])",
    "dots": r"(?<![\d.])\d{2}\.\d{2}\.\d{4}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])",
    "abroad": r"(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]\(\d{1,4}\)[ .-]?|[ .-])\d{1,4}(?:[ .-]?\d{2,4}){1,5}(?![\w-])",
    "joined": r"(?<![\w+])\+[2-9]\d{7,14}(?![\w-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
}
#: Issuers' prefixes by a card number's length (fixed values).
ISSUERS = r"^(?:4(?=(?:\d{12}|\d{15}|\d{18})$)|(?:5[1-5]|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)(?=(?:\d{12}|\d{14})$)|3[47](?=\d{13}$)|(?:30[0-5]|3[689])(?=\d{11,17}$)|(?:6011|64[4-9]|65|62|35(?:2[89]|[3-8]\d))(?=\d{12,17}$))"
FOUND = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without these has no match.
HINT = r"[0-9@=:]|AKIA"
DAYS = (270, 271)
WALK = 64


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def prf(key: str, tag: str, round_: str, value: str) -> str:
    """A keyed 60-bit number of a value, as SQL."""
    return f"cast(conv(substr(sha2(concat_ws('|', {quoted(key)}, '{tag}', {round_}, {value}), 256), 1, 15), 16, 10) as bigint)"


def feistel(key: str, tag: str, left: str, right: str, a: str, b: str, then: str) -> str:
    """SQL for `then`, an expression over s.l and s.r, the permuted pair of left in [0, a) and right in [0, b)."""
    step = f"if(i % 2 = 0, named_struct('l', pmod(s.l + {prf(key, tag, 'i', 's.r')}, {a}), 'r', s.r), named_struct('l', s.l, 'r', pmod(s.r + {prf(key, tag, 'i', 's.l')}, {b})))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> {step}, s -> {then})"


def digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def laid_out(m: str, new: str) -> str:
    """The digits `new`, worked out once, in the layout of m."""
    step = "if(ch between '0' and '9', named_struct('t', concat(w.t, substr(z, w.i, 1)), 'i', w.i + 1), named_struct('t', concat(w.t, ch), 'i', w.i))"
    return let(new, "z", f"aggregate(split({m}, ''), named_struct('t', '', 'i', 1), (w, ch) -> {step}, w -> w.t)")


def digit_run(key: str, tag: str, d: str, n: str) -> str:
    """The n-digit string d permuted among n-digit strings; n at most 18."""
    half = f"cast(floor({n} / 2) as int)"
    size_l, size_r = f"cast(power(10, {half}) as bigint)", f"cast(power(10, {n} - {half}) as bigint)"
    return feistel(key, tag, f"substr({d}, 1, {half})", f"substr({d}, {half} + 1)", size_l, size_r, f"concat(lpad(s.l, {half}, '0'), lpad(s.r, {n} - {half}, '0'))")


def luhn_sum(d: str, doubled: int) -> str:
    """The Luhn sum of d; doubled: parity, from the right, of the digits that count twice."""
    return f"aggregate(transform(split(reverse({d}), ''), (c, k) -> if(k % 2 = {doubled}, 2 * cast(c as int) - if(cast(c as int) > 4, 9, 0), cast(c as int))), 0, (x, y) -> x + y)"


def date_of(key: str, m: str, form: str, walk: bool = False) -> str:
    """m, a date in the format, permuted; m itself if it isn't a date in range.

    walk: m's day is above 12, and the permutation is followed until it comes to such a day again. A step misses with
    a chance of 0.4, so WALK steps end in one but for a chance of 1e-25.
    """
    day = f"datediff(try_to_timestamp({m}, '{form}'), date'1900-01-01')"
    date = lambda d: f"date_add(date'1900-01-01', cast({d} as int))"
    step = lambda d: feistel(key, "date", f"floor({d} / {DAYS[1]})", f"{d} % {DAYS[1]}", str(DAYS[0]), str(DAYS[1]), f"s.l * {DAYS[1]} + s.r")
    to = f"aggregate(sequence(1, {WALK}), cast(d as bigint), (w, k) -> if(k > 1 and day({date('w')}) > 12, w, {step('w')}))" if walk else step("d")
    return let(day, "d", f"if(d between 0 and {DAYS[0] * DAYS[1] - 1}, date_format({date(to)}, '{form}'), {m})")


def let(value: str, name: str, then: str) -> str:
    """`then` with the name standing for a value that is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def letters(key: str, tag: str, value: str, n: str) -> str:
    """n lower-case letters, a keyed digest, over again beyond 64."""
    return f"translate(substr(repeat(sha2(concat_ws('|', {quoted(key)}, '{tag}', {value}), 256), cast(ceil({n} / 64) as int)), 1, {n}), '0123456789', 'ghijklmnop')"


def pseudonym(key: str, m: str = "m") -> str:
    """SQL for the replacement of a match m."""
    is_ = lambda name: f"{m} rlike {quoted('^(?:' + PATTERNS[name] + ')$')}"
    octets = f"split({m}, '[.]')"
    ip = feistel(
        key, "ip", f"cast({octets}[0] as bigint) * 256 + cast({octets}[1] as bigint)", f"cast({octets}[2] as bigint) * 256 + cast({octets}[3] as bigint)", "65536", "65536",
        "concat_ws('.', floor(s.l / 256), s.l % 256, floor(s.r / 256), s.r % 256)",
    )
    # a social security number is (area, group, serial); areas 000, 666 and 9xx, group 00 and serial 0000 don't occur
    area, rest = "cast(substr(d, 1, 3) as int)", "(cast(substr(d, 4, 2) as int) - 1) * 9999 + cast(substr(d, 6) as int) - 1"
    as_ssn = feistel(key, "ssn", f"{area} - 1 - if({area} > 666, 1, 0)", rest, "898", "989901", "concat(lpad(s.l + 1 + if(s.l + 1 >= 666, 1, 0), 3, '0'), '-', lpad(floor(s.r / 9999) + 1, 2, '0'), '-', lpad(s.r % 9999 + 1, 4, '0'))")
    ssn = let(digits(m), "d", f"if({area} in (0, 666) or {area} >= 900 or substr(d, 4, 2) = '00' or substr(d, 6) = '0000', {m}, {as_ssn})")
    # (area, exchange and line); areas under 200 are permuted apart from the others
    low, exchange = "substr(e, 1, 3) < '200'", "cast(substr(e, 4, 3) as bigint)"
    moved = feistel(
        key, "phone", f"cast(substr(e, 1, 3) as bigint) - if({low}, 0, 200)", f"({exchange} - 200) * 10000 + cast(substr(e, 7) as bigint)", f"if({low}, 200, 800)", "8000000",
        f"concat(lpad(s.l + if({low}, 0, 200), 3, '0'), lpad(floor(s.r / 10000) + 200, 3, '0'), lpad(s.r % 10000, 4, '0'))",
    )
    as_phone = let("right(d, 10)", "e", f"if({exchange} < 200 or ({low} and not {m} rlike '[+(]'), {m}, {laid_out(m, f'concat(left(d, length(d) - 10), {moved})')})")
    phone = let(digits(m), "d", as_phone)
    # numbers of other countries: the digits of the country stay, one of them where nothing ends it
    rest = digit_run(key, "abroad", "substr(d, c + 1)", "(length(d) - c)")
    abroad = let(digits(m), "d", let(f"length(regexp_extract({m}, '^[+]([0-9]+)', 1))", "c", f"if(length(d) between 8 and 15, {laid_out(m, f'concat(left(d, c), {rest})')}, {m})"))
    joined = let(digits(m), "d", let("1", "c", laid_out(m, f"concat(left(d, c), {rest})")))
    # all between the issuer's prefix and the check digit is permuted, then a fitting check digit is found
    body = f"concat(p, {digit_run(key, 'card', 'substr(d, length(p) + 1, length(d) - length(p) - 1)', '(length(d) - length(p) - 1)')})"
    as_card = let(body, "e", laid_out(m, f"concat(e, pmod(-({luhn_sum('e', 0)}), 10))"))
    card = let(digits(m), "d", let(f"regexp_extract(d, {quoted(ISSUERS)}, 0)", "p", f"if(p = '' or {luhn_sum('d', 1)} % 10 <> 0, {m}, {as_card})"))
    local = f"length(substring_index({m}, '@', 1))"
    email = f"concat({letters(key, 'email', m, f'greatest({local}, 16)')}, '@', {letters(key, 'host', 'substring_index(' + m + ', ' + quoted('@') + ', -1)', '16')}, '.invalid')"
    cloud = f"concat('AKIA', upper({letters(key, 'cloud', m, '16')}))"
    lead = f"regexp_extract({m}, {quoted(PATTERNS['secret'].rsplit('[^', 1)[0].join('()'))}, 1)"
    secret = let(lead, "p", f"concat(p, {letters(key, 'secret', f'substr({m}, length(p) + 1)', f'length({m}) - length(p)')})")
    slash = f"if(try_to_timestamp({m}, 'dd/MM/yyyy') is not null, {date_of(key, m, 'dd/MM/yyyy')}, {date_of(key, m, 'MM/dd/yyyy', walk=True)})"
    how = {
        "email": email, "cloud": cloud, "secret": secret, "ip": ip, "iso": date_of(key, m, "yyyy-MM-dd"), "slash": slash, "dots": date_of(key, m, "dd.MM.yyyy"), "ssn": ssn, "phone": phone, "abroad": abroad, "joined": joined,
        "card": card,
    }
    return "case " + " ".join(f"when {is_(k)} then {v}" for k, v in how.items()) + f" else {m} end"


def replaced(text: str, key: str) -> tuple[Column, Column]:
    """(array of matches, array of their replacements) of a text column."""
    found = F.expr(f"if({text} rlike {quoted(HINT)}, regexp_extract_all({text}, {quoted(FOUND)}, 0), array())")
    return found, F.expr(f"transform(found, m -> {pseudonym(key)})")


def key_of(spark: SparkSession, otherwise: str | None = None) -> str:
    """The session's key, from KEY; without one and without another to take, an error."""
    key = spark.conf.get(KEY, None) or otherwise
    if not key:
        raise ValueError(f"pseudonyms need a key: set {KEY}")
    return key


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """The rows of docs with personal data in text replaced; columns as before."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"))
    new = _with_new_text(packed, key)
    return new.select(*[F.col("text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])


def _with_new_text(df: DataFrame, key: str) -> DataFrame:
    found, to = replaced("text", key)
    df = df.withColumn("found", found).withColumn("new", to)
    joined = F.expr(f"array_join(zip_with(split(text, {quoted(FOUND)}, -1), new, (a, b) -> concat(a, coalesce(b, ''))), '')")
    return df.withColumn("n", F.expr("cast(coalesce(size(filter(zip_with(found, new, (a, b) -> a <> b), x -> x)), 0) as bigint)")).withColumn("text", F.when(F.size("found") > 0, joined).otherwise(F.col("text")))


def pseudonym_rows(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_replaced and the text with its personal data replaced."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_new_text(rows, key).select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n")).alias("n_replaced"), "text")
