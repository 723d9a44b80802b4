"""Operator 4 against a plain Feistel network, and distinct values against distinct pseudonyms in every format."""

import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.llm import pseudonyms

KEY = "a key"


def feistel(tag, left, right, a, b):
    for i in range(8):
        f = lambda v: int(hashlib.sha256(f"{KEY}|{tag}|{i}|{v}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        left, right = ((left + f(right)) % a, right) if i % 2 == 0 else (left, (right + f(left)) % b)
    return left, right


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10


def ip(v):
    a, b, c, d = map(int, v.split("."))
    x, y = feistel("ip", a * 256 + b, c * 256 + d, 65536, 65536)
    return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"


def date(v, form, walk=False):
    d = (datetime.datetime.strptime(v, form).date() - datetime.date(1900, 1, 1)).days
    while True:
        x, y = feistel("date", d // 271, d % 271, 270, 271)
        d = x * 271 + y
        out = datetime.date(1900, 1, 1) + datetime.timedelta(d)
        if not walk or out.day > 12:
            return out.strftime(form)


def ssn(v):
    area = int(v[:3])
    x, y = feistel("ssn", area - 1 - (area > 666), (int(v[4:6]) - 1) * 9999 + int(v[7:]) - 1, 898, 989901)
    x += 1 + (x + 1 >= 666)
    return f"{x:03}-{y // 9999 + 1:02}-{y % 9999 + 1:04}"


def phone(v):
    d = re.sub(r"\D", "", v)
    area, exchange, line = int(d[-10:-7]), int(d[-7:-4]), int(d[-4:])
    low = area < 200
    x, y = feistel("phone", area - (0 if low else 200), (exchange - 200) * 10000 + line, 200 if low else 800, 8_000_000)
    new = iter(d[:-10] + f"{x + (0 if low else 200):03}{y // 10000 + 200:03}{y % 10000:04}")
    return "".join(next(new) if c.isdigit() else c for c in v)


def run(tag, d):
    half = len(d) // 2
    x, y = feistel(tag, int(d[:half]), int(d[half:]), 10**half, 10 ** (len(d) - half))
    return f"{x:0{half}}{y:0{len(d) - half}}"


def card(v, prefix):
    d = re.sub(r"\D", "", v)
    body = d[:prefix] + run("card", d[prefix:-1])
    body += str(next(c for c in range(10) if luhn(body + str(c)) == 0))
    new = iter(body)
    return "".join(next(new) if c.isdigit() else c for c in v)


def replaced(spark, values):
    rows = spark.createDataFrame([(i, f"see {v} here") for i, v in enumerate(values)], "doc_id long, text string")
    return [r.text[4:-5] for r in pseudonyms.pseudonym_rows(rows, KEY).orderBy("doc_id").collect()]


def test_against_a_plain_network(spark):
    want = {
        "10.1.2.3": ip("10.1.2.3"), "0.0.0.0": ip("0.0.0.0"), "255.255.255.255": ip("255.255.255.255"),
        "1980-02-29": date("1980-02-29", "%Y-%m-%d"), "31/12/1999": date("31/12/1999", "%d/%m/%Y"), "05/06/1999": date("05/06/1999", "%d/%m/%Y"), "12/31/1999": date("12/31/1999", "%m/%d/%Y", True), "01.02.1903": date("01.02.1903", "%d.%m.%Y"),
        "123-45-6789": ssn("123-45-6789"), "899-99-9999": ssn("899-99-9999"), "001-01-0001": ssn("001-01-0001"),
        "(212) 555-0187": phone("(212) 555-0187"), "+1 (017) 555-7713": phone("+1 (017) 555-7713"), "212-555-0187": phone("212-555-0187"), "+1 999.999.9999": phone("+1 999.999.9999"),
        "4111 1111 1111 1111": card("4111 1111 1111 1111", 1), "5500-0000-0000-0004": card("5500-0000-0000-0004", 2), "378282246310005": card("378282246310005", 2), "6011000990139424": card("6011000990139424", 4),
        "+44 20 7946 0958": "+44 " + (d := run("abroad", "2079460958"))[:2] + " " + d[2:6] + " " + d[6:], "+442079460958": "+4" + run("abroad", "42079460958"), "+49 (30) 901820": "+49 (" + (d := run("abroad", "30901820"))[:2] + ") " + d[2:],
    }
    got = dict(zip(want, replaced(spark, list(want))))
    assert got == want and not any(k == v for k, v in got.items())
    # one number in two layouts stays linked
    assert re.sub(r"\D", "", got["(212) 555-0187"]) == re.sub(r"\D", "", got["212-555-0187"])


def days(form):
    return [(datetime.date(1999, 11, 1) + datetime.timedelta(i)).strftime(form) for i in range(1500)]


RNG = random.Random(4)
FORMS = {
    "slash": sorted({*days("%d/%m/%Y"), *days("%m/%d/%Y")}), "iso": days("%Y-%m-%d"), "dots": days("%d.%m.%Y"),
    "ip": sorted({".".join(str(RNG.randrange(256)) for _ in range(4)) for _ in range(3000)} | {f"10.0.{i}.{j}" for i in range(9) for j in range(99)}),
    "ssn": [f"{a:03}-{g:02}-{s:04}" for a in (1, 665, 667, 899) for g in (1, 50, 99) for s in range(1, 150)],
    "phone": [f"({a:03}) {e}-{n:04}" for a in (0, 17, 199, 200, 555, 999) for e in (200, 555, 999) for n in range(90)] + [f"{a}-555-{n:04}" for a in (200, 999) for n in range(90)],
    "email": [f"u{i}@example{i % 7}.com" for i in range(3000)],
    "secret": [f"access_token={'x' * (i % 150)}{i:06}" for i in range(1500)],
    "abroad": [f"+{c} {n:03} {n * 37 % 10000:04}" for c in (2, 44, 351) for n in range(400)] + [f"+44{n:09}" for n in range(500)],
}


@pytest.mark.parametrize("form", FORMS)
def test_distinct_values_stay_distinct(spark, form):
    values = FORMS[form]
    got = replaced(spark, values)
    assert len(set(values)) == len(values) == len(set(got))
    shape = lambda v: re.sub(r"\d", "9", v)
    if form in ("slash", "iso", "dots", "ssn", "phone", "abroad"):
        assert [shape(v) for v in got] == [shape(v) for v in values]


def test_long_secrets_leave_nothing(spark):
    secret = "eyJ" + "Ab9_" * 90
    got = replaced(spark, [f"db_password: {secret}", f'client_secret="{secret}"'])
    assert all("Ab9" not in g for g in got) and [len(g) for g in got] == [len(secret) + 13, len(secret) + 16]


def test_others_are_left_alone(spark, docs):
    plain_texts = [
        "", None, "version 1.2.3.4.5", "999.1.1.1", "010.1.2.3", "4111 1111 1111 1112", "9800000000000000", "7992739871300000", "2024-13-45", "000-12-3456", "no data, 12 of 30", "000 000 0000", "lines 123.456.7890", "31/02/2000", "13/13/2000", "+1 000",
    ]
    table = spark.createDataFrame(list(enumerate(plain_texts)), "doc_id long, text string")
    assert [(r.n_replaced, r.text) for r in pseudonyms.pseudonym_rows(table, KEY).orderBy("doc_id").collect()] == [(0, t) for t in plain_texts]
    out = pseudonyms.pseudonymised(docs, KEY)
    assert out.columns == docs.columns and out.drop("text").exceptAll(docs.drop("text")).isEmpty() and out.count() == docs.count()


def test_clashing_names(spark):
    names = "doc_id long, text string, found string, new string, n string, m string, d string, e string, s string"
    rows = spark.createDataFrame([(1, "on 2001-02-03", *"abcdefg")], names)
    got = pseudonyms.pseudonymised(rows, KEY).first()
    assert got.text == "on " + date("2001-02-03", "%Y-%m-%d") and tuple(got)[2:] == tuple("abcdefg")


def test_it_stays_native(spark):
    table = spark.range(9).select(F.col("id").alias("doc_id"), F.concat(F.lit("on 2001-01-0"), F.col("id")).alias("text"))
    plan = pseudonyms.pseudonym_rows(table, KEY)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_a_key_is_needed(spark):
    with pytest.raises(ValueError):
        pseudonyms.key_of(spark)
