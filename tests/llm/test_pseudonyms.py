"""Pseudonyms against a Feistel network in plain Python: same values, same kinds, undone again."""

import datetime
import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from basketry.llm import pii

KEY = "k"


def feistel(left, right, sl, sr, tweak):
    for k in range(pii.ROUNDS):
        if k % 2 == 0:
            left = (left + int(hashlib.sha256(f"{KEY}|{tweak}|{k}|{sl}|{sr}|{right}".encode()).hexdigest()[:15], 16) % sl) % sl
        else:
            right = (right + int(hashlib.sha256(f"{KEY}|{tweak}|{k}|{sl}|{sr}|{left}".encode()).hexdigest()[:15], 16) % sr) % sr
    return left, right


def digits(d, tweak):
    half = len(d) // 2
    l, r = feistel(int(d[:half]), int(d[half:]), 10**half, 10 ** (len(d) - half), tweak)
    return f"{l:0{half}}{r:0{len(d) - half}}"


def check_digit(body):
    doubled = [int(c) * 2 for c in body[::-1][::2]]
    return (-sum(d - 9 if d > 9 else d for d in doubled) - sum(int(c) for c in body[::-1][1::2])) % 10


def ssn(d):
    areas = [a for a in range(1, 900) if a != 666]
    l, r = feistel(areas.index(int(d[:3])) * 99 + int(d[3:5]) - 1, int(d[5:]) - 1, 898 * 99, 9999, "ssn")
    return f"{areas[l // 99]:03}{l % 99 + 1:02}{r + 1:04}"


def number(d):
    body = digits(d[:-1], "number")
    turn = int(hashlib.sha256(f"{KEY}|turn|{body}".encode()).hexdigest()[:8], 16) % 9
    gap = ((int(d[-1]) - check_digit(d[:-1])) % 10 - 1 + turn) % 9
    return body + str((check_digit(body) + gap + 1) % 10)


def day(d):
    first = datetime.date(1800, 1, 1)
    l, r = feistel(*divmod((d - first).days, 773), 189, 773, "date")
    return first + datetime.timedelta(l * 773 + r)


def moved(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").repartition(3)
    out = pii.pseudonymise(rows, KEY).cache()
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymise(out.select("doc_id", "text"), KEY, undo=True).collect()}
    got = {r["doc_id"]: r for r in out.collect()}
    return [got[k] for k in range(len(values))], [back[k] for k in range(len(values))]


def kinds(rows):
    return [tuple(r[f"n_{k}"] for k in pii.KINDS) for r in rows]


def test_numbers_equal_brute_force_and_keep_their_kind(spark):
    rng = np.random.default_rng(2)
    some = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    valid = [f"{a:03}{b:02}{c:04}" for a, b, c in zip(rng.choice([x for x in range(1, 900) if x != 666], 300), rng.integers(1, 100, 300), rng.integers(1, 10000, 300), strict=True)]
    bodies = [some(int(n)) for n in rng.integers(12, 19, 200)]
    cards = [b + str(check_digit(b)) for b in bodies]
    numbers = [b + str((check_digit(b) + int(g)) % 10) for b, g in zip(bodies, rng.integers(1, 10, 200), strict=True)]
    values = [f"{d[:3]}-{d[3:5]}-{d[5:]}" for d in valid] + cards + numbers
    got, back = moved(spark, values)
    shown = [r["text"] for r in got]
    assert [re.sub("-", "", t) for t in shown[:300]] == [ssn(d) for d in valid]
    assert shown[300:500] == [b + str(check_digit(b)) for b in (digits(x[:-1], "card") for x in cards)]
    assert shown[500:] == [number(x) for x in numbers]
    again, _ = moved(spark, shown)
    assert kinds(again) == kinds(got) == [(0, 0, 0, 1, 0, 0, 0, 0)] * 300 + [(0, 0, 0, 0, 0, 1, 0, 0)] * 200 + [(0, 0, 0, 0, 0, 0, 1, 0)] * 200
    assert back == values


def test_dates_keep_their_notation_and_are_undone(spark):
    rng = np.random.default_rng(3)
    first = datetime.date(1900, 1, 1)
    dates = [first + datetime.timedelta(int(n)) for n in rng.integers(0, 70_000, 120)]
    iso = [f"{d:%Y-%m-%d}" for d in dates]
    padded, dots = [f"{d:%d/%m/%Y}" for d in dates], [f"{d:%d.%m.%Y}" for d in dates]
    us = [f"{d:%m/%d/%Y}" for d in dates if d.day > 12]
    bare = [f"{d.day}/{d.month}/{d.year}" for d in dates if d.day < 10 or d.month < 10]
    short = [f"{d.month}/{d.day}/{d:%y}" for d in dates if d.day > 12 and d.month < 10]
    values = [*iso, *padded, *dots, *us, *bare, *short]
    got, back = moved(spark, values)
    shown = [r["text"] for r in got]
    assert back == values and kinds(got) == [(0, 0, 1, 0, 0, 0, 0, 0)] * len(values)
    n = len(dates)
    assert shown[:n] == [f"{day(d):%Y-%m-%d}" for d in dates]
    assert shown[n : 2 * n] == [f"{day(d):%d/%m/%Y}" for d in dates] and shown[2 * n : 3 * n] == [f"{day(d):%d.%m.%Y}" for d in dates]
    assert all(re.fullmatch(r"\d\d/(1[3-9]|2\d|3[01])/\d{4}", t) for t in shown[3 * n : 3 * n + len(us)])
    assert all(re.fullmatch(r"\d{1,2}/\d{1,2}/\d{4}", t) and re.search(r"(^|/)\d/", t) for t in shown[3 * n + len(us) : 3 * n + len(us) + len(bare)])
    assert not set(shown) & {"12/25/1999", "3/4/99"}


def test_nothing_of_a_value_stays_in_clear(spark):
    name = "n" * 96
    text = f"mail {name}@x.org, {'..' + name}@x.org on 12/25/1999 and 3/4/99 from 10.1.2.3 or +44 (20) 7946 0018"
    got, back = moved(spark, [text, "x" * 300_000 + f" 078-05-1120 {text}"])
    for r in got:
        assert not any(x in r["text"] for x in (name[:8], "12/25/1999", "3/4/99", "10.1.2.3", "7946 0018", "078-05-1120"))
    assert re.sub(r"u[0-9a-f]{12}@mail\.invalid", "M", back[0]) == re.sub(r"[.n]+@x\.org", "M", text)


def test_tables_of_numbers_do_not_change(spark):
    rng = np.random.default_rng(5)
    texts = ["years 1990 1991 1992 rose", "values 100 200 300 400", "coordinates 52.5200 13.4050 100.20", "table 10 20 30 40", "2019 2020 2021 2022 2023", "1 000 000 and 12 345 678", "from 1990-1995 and 200-300-400", "123.456.789", "page 12-34-56-78", "01 02 03 04 05 06", "0.10 0.20 0.30 0.40", "(2019) 100 200 300", "3.1415 926 535 8979"]
    for _ in range(200):
        widths, sep = rng.integers(1, 5, rng.integers(3, 9)), str(rng.choice([" ", "  ", "\t", ", "]))
        texts.append("row " + sep.join(str(int(rng.integers(10 ** (w - 1), 10**w))) for w in widths) + " end")
    got, _ = moved(spark, texts)
    assert [r["text"] for r in got] == texts


def test_telephone_numbers_of_many_notations(spark):
    values = ["+49 30 1234567", "+1 4155550123", "+1 (988) 555-2485", "+44 (20) 7946 0018", "+4915112345678", "+33 1 23 45 67 89", "415-555-0123", "(415) 555-0123", "415.555.0123", "030 1234567", "0171 234 5678", "(030) 1234567", "020 7946 0018", "01 23 45 67 89", "+49/30/1234567"]
    texts = [f"so {v} it is" for v in values] + ["Tel: 030 123 456", "phone 5550123", "Call (55) 1234 5678.", "fax. 12 34 56 78 90", "Tel.: 11 22 33 44"]
    got, back = moved(spark, texts)
    assert back == texts and [r["n_phone"] for r in got] == [1] * len(texts)
    shape = lambda t: re.sub("[0-9]", "9", t)
    for r, t in zip(got, texts, strict=True):
        assert r["text"] != t and shape(r["text"]) == shape(t)
    again, _ = moved(spark, [r["text"] for r in got])
    assert kinds(again) == kinds(got)


def test_account_numbers(spark):
    def check(account):
        turned = account[4:] + account[:2] + "00"
        return f"{98 - int(''.join(str(int(c, 36)) for c in turned)) % 97:02}"

    rng = np.random.default_rng(6)
    plain = ["DE00" + "".join(map(str, rng.integers(0, 10, 18))) for _ in range(40)] + ["GB00WEST" + "".join(map(str, rng.integers(0, 10, 14))) for _ in range(40)] + ["FR0020041010050500013M02606"]
    valid = [a[:2] + check(a) + a[4:] for a in plain]
    spaced = [" ".join(a[k : k + 4] for k in range(0, len(a), 4)) for a in valid]
    wrong = [a[:2] + f"{(int(a[2:4]) + 1) % 100:02}" + a[4:] for a in valid]
    got, back = moved(spark, valid + spaced + wrong)
    n = len(valid)
    assert back == valid + spaced + wrong and [r["n_iban"] for r in got] == [1] * (2 * n) + [0] * n
    for a, r, s in zip(valid, got[:n], got[n : 2 * n], strict=True):
        t = r["text"]
        assert t != a and t == t[:2] + check(t) + t[4:] and re.sub("[0-9]", "9", t) == re.sub("[0-9]", "9", a) and s["text"].replace(" ", "") == t
    assert [r["text"] for r in got[2 * n :]] == wrong


def test_awkward_tables(spark):
    rows = spark.createDataFrame([(1, None, "m"), (1, None, "m"), (None, "id 123-45-6789", "m"), (2, "", "m")], "doc_id long, text string, found string").withColumn("m", F.lit(1))
    got = pii.pseudonymise(rows, KEY)
    assert got.count() == 4 and got.where("text is null").count() == 2 and got.where("doc_id is null and n_ssn = 1").count() == 1
    assert pii.pseudonymise(rows.limit(0), KEY).count() == 0
