import hashlib
import random
import re
from datetime import date

import regex
from pyspark.sql import functions as F

from loomquery.llm import pii
from loomquery.llm.queries import QUERIES

KEY = "a test's key"


def keyed(key, tag, r, half):
    return int(hashlib.sha256(f"{key}|{tag}|{r}|{half}".encode()).hexdigest()[:15], 16)


def network(key, tag, a, b, m, n):
    for r in range(10):
        if r % 2:
            b = (b + keyed(key, tag, r, a) % n) % n
        else:
            a = (a + keyed(key, tag, r, b) % m) % m
    return a, b


def digits_of(d, key, tag):
    left = len(d) // 2
    a, b = network(key, f"{tag}{len(d)}", int(d[:left]), int(d[left:]), 10**left, 10 ** (len(d) - left))
    return f"{a:0{left}}{b:0{len(d) - left}}"


def luhn(s):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def with_luhn(body):
    return next(body + c for c in "0123456789" if luhn(body + c))


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def iban(country, tail):
    return f"{country}{98 - mod97(tail + country + '00'):02}{tail}"


def mapped(spark, values, key=KEY):
    df = spark.createDataFrame([(v,) for v in values], "m string").repartition(8)
    return {r["m"]: r["p"] for r in df.select("m", pii.pseudonym(F.col("m"), key).alias("p")).collect()}


def test_digits_match_brute_force_and_are_permuted(spark):
    for n in (2, 3, 4):
        df = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
        got = {r["d"]: r["p"] for r in df.select("d", pii.permuted_digits(F.col("d"), "k").alias("p")).collect()}
        assert sorted(got.values()) == [f"{i:0{n}}" for i in range(10**n)] == sorted(got)
        assert got == {d: digits_of(d, "k", "digits") for d in got} and list(got) != list(got.values())
    long = ["9" * 30, "0" * 23, "7", ""]
    df = spark.createDataFrame([(d,) for d in long], "d string").select("d", pii.permuted_digits(F.col("d"), "k").alias("p"))
    assert {r["d"]: r["p"] for r in df.collect()} == {d: digits_of(d, "k", "digits") if len(d) > 1 else d for d in long}


def test_all_days_in_all_formats(spark):
    """Distinct strings get distinct pseudonyms of their format, and one day is one day in all of them."""
    forms = {"yyyy-MM-dd": r"\d{4}-\d\d-\d\d", "yyyy/MM/dd": r"\d{4}/\d\d/\d\d", "dd.MM.yyyy": r"\d\d\.\d\d\.\d{4}", "dd-MM-yyyy": r"\d\d-\d\d-\d{4}", "dd/MM/yyyy": r"\d\d/(0\d|1[0-2])/\d{4}", "MM/dd/yyyy": r"(0\d|1[0-2])/(1[3-9]|[23]\d)/\d{4}"}
    days = spark.range(0, 73049, 1, 8).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    seen = None
    for form, shape in forms.items():
        some = days if form != "MM/dd/yyyy" else days.filter("day(d) > 12")
        got = some.select("d", pii.pseudonym(F.date_format("d", form), KEY).alias("p")).select("d", "p", F.try_to_date("p", form).alias("to")).collect()
        assert len({r["p"] for r in got}) == len(got) and all(re.fullmatch(shape, r["p"]) for r in got)
        to = {r["d"]: r["to"] for r in got}
        assert None not in to.values() and all(1900 <= t.year <= 2099 for t in to.values())
        seen = seen or to
        assert all(seen[d] == t for d, t in to.items())
    assert sum(d == t for d, t in seen.items()) < 50


def test_dates_match_brute_force(spark):
    rng = random.Random(4)

    def wanted(y, m, d):
        month = (y - 1900) * 12 + m - 1
        if d <= 12:
            x = month * 12 + d - 1
            a, b = network(KEY, "early", x // 180, x % 180, 160, 180)
            x = a * 180 + b
            return f"{1900 + x // 144}-{x // 12 % 12 + 1:02}-{x % 12 + 1:02}"
        x = month * 19 + d - 13
        while True:
            a, b = network(KEY, "late", x // 228, x % 228, 200, 228)
            x = a * 228 + b
            y, m, d = 1900 + x // 228, x // 19 % 12 + 1, x % 19 + 13
            if d <= (29 if m == 2 and y % 4 == 0 and y != 1900 else [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m - 1]):
                return f"{y}-{m:02}-{d:02}"

    some = [(rng.randint(1900, 2099), rng.randint(1, 12), rng.randint(1, 28)) for _ in range(300)]
    got = mapped(spark, [f"{y}-{m:02}-{d:02}" for y, m, d in some])
    assert got == {f"{y}-{m:02}-{d:02}": wanted(y, m, d) for y, m, d in some}


def test_cards_and_accounts_stay_valid_and_linked(spark):
    rng = random.Random(5)
    cards = [with_luhn("".join(rng.choices("0123456789", k=n))) for n in (12, 15, 18) for _ in range(200)]
    got = mapped(spark, cards)
    assert got == {c: with_luhn(digits_of(c[:-1], KEY, "card")) for c in cards} and len(set(got.values())) == len(set(cards))
    shapes = mapped(spark, ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"])
    plain = {re.sub(r"\D", "", p) for p in shapes.values()}
    assert len(plain) == 1 and all(re.sub(r"\d", "", p) == re.sub(r"\d", "", m) for m, p in shapes.items())

    accounts = ["DE89370400440532013000", *(iban("FR", "".join(rng.choices("0123456789", k=10)) + "AB1" + "".join(rng.choices("0123456789", k=10))) for _ in range(100))]
    got = mapped(spark, accounts)
    for m, p in got.items():
        numbers = digits_of(re.sub(r"\D", "", m[4:]), KEY, "iban")
        fresh = iter(numbers)
        assert p == iban(m[:2], re.sub(r"\d", lambda _, fresh=fresh: next(fresh), m[4:])) and mod97(p[4:] + p[:4]) == 1
    assert mapped(spark, ["DE89 3704 0044 0532 0130 00"])["DE89 3704 0044 0532 0130 00"].replace(" ", "") == got["DE89370400440532013000"]


def test_social_numbers_stay_in_their_ranges(spark):
    some = [f"{a:03}-{g:02}-{s:04}" for a in (1, 665, 667, 899) for g in (1, 50, 99) for s in (1, 2, 5000, 9999)]
    got = mapped(spark, some)
    for m, p in got.items():
        a, g, s = map(int, m.split("-"))
        x, y = network(KEY, "social", a - 1 - (a > 666), (g - 1) * 9999 + s - 1, 898, 99 * 9999)
        assert p == f"{x + 1 + (x >= 665):03}-{y // 9999 + 1:02}-{y % 9999 + 1:04}"
    assert len(set(got.values())) == len(some)


def test_secrets_keep_length_and_style(spark):
    rng = random.Random(6)
    some = ["a1" + "".join(rng.choices("0123456789abcdef", k=n - 2)) for n in (24, 25, 40, 129, 300, 1001) for _ in range(20)]
    got = mapped(spark, some + [s.upper() for s in some])
    for s in some:
        assert len(got[s]) == len(s) and got[s] != s and got[s.upper()] == got[s].upper() and re.fullmatch("[0-9a-f]+", got[s])
    assert len({got[s] for s in some}) == len(set(some))
    # a difference in either half moves both
    a, b = "0" * 30 + "a" * 30, "0" * 30 + "a" * 29 + "b"
    two = mapped(spark, [a, b])
    assert two[a][:30] != two[b][:30] and two[a][30:] != two[b][30:]


def test_what_only_looks_alike_stays(spark):
    other = ["000-00-0000", "666-12-1234", "900-12-1234", "123-00-1234", "123-45-0000", "202401010000", "1234567890123456", "4111111111111112", "DE88370400440532013000", "2023-02-30", "31/31/2000", "13/13/2000", "1899-12-31", "2100-01-01", "300.1.1.1"]
    assert mapped(spark, other) == {m: m for m in other}


def test_texts(spark, empty, trouble):
    private = ["jörg.meier-7@mail.example.com", "+1 (017) 555-7713", "97.51.17.173", "4845168114407329", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "123-45-6789", "2024-02-29", "31.12.1999", "DE89 3704 0044 0532 0130 00"]
    plain = ["300.1.1.1", "2023-02-30", "chapter 12", "v1.2.3", "a@b", "99", "9807915762804490", "202401010000", "000-00-0000"]
    body = "start " + " and ".join(private) + ". Then " + " or ".join(plain) + " end"
    df = spark.createDataFrame([(1, body), (2, body), (3, None), (4, ""), (5, "no such thing"), (6, "at 2024-01-01T00:00:00 sharp")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(df, KEY).collect()}
    assert not [p for p in private if p in got[1]["text"]] and not [p for p in plain if p not in got[1]["text"]]
    assert got[1]["text"] == got[2]["text"] and got[1]["n_replaced"] == len(private)
    assert re.sub(r"\S", "", got[1]["text"]) == re.sub(r"\S", "", body)
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "no such thing" and got[5]["n_replaced"] == 0
    assert got[6]["n_replaced"] == 1 and re.fullmatch(r"at \d{4}-\d\d-\d\dT00:00:00 sharp", got[6]["text"])
    again = pii.pseudonymise(df, "another").filter("doc_id = 1").first()
    assert again["text"] != got[1]["text"]


def test_rows_of_trouble(spark, empty, trouble):
    assert pii.pseudonymise(empty, KEY).count() == 0
    before = sorted((r["doc_id"] or 0, r["text"] or "", r["text"] is None) for r in trouble.collect())
    after = pii.pseudonymise(trouble, KEY)
    assert after.columns == ["doc_id", "n_replaced", "text"]
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["text"] is None) for r in after.collect()) == before
    long = spark.createDataFrame([("x", "word " * 50_000 + "4845168114407329 " * 500)], "doc_id string, text string")
    got = pii.pseudonymise(long, KEY).first()
    assert got["n_replaced"] == 500 and len(got["text"]) == 50_000 * 5 + 500 * 17


def day_of(m):
    """Format and day of a date-like string."""
    y, a, b = (m[:4], m[5:7], m[8:]) if m[4] in "-/" and m[:4].isdigit() else (m[6:], m[3:5], m[:2])
    swapped = m[2] == "/" and int(a) > 12
    if swapped:
        a, b = b, a
    try:
        return swapped, date(int(y), int(a), int(b))
    except ValueError:
        return swapped, None


def moved(day):
    late, month = day.day > 12, (day.year - 1900) * 12 + day.month - 1
    width, first, sides, tag = (19, 13, (200, 228), "late") if late else (12, 1, (160, 180), "early")
    x = month * width + day.day - first
    while True:
        a, b = network(KEY, tag, x // sides[1], x % sides[1], *sides)
        x = a * sides[1] + b
        try:
            return date(1900 + x // (12 * width), x // width % 12 + 1, x % width + first)
        except ValueError:
            pass


def added(half, other, r):
    stream = "".join(hashlib.sha256(f"{KEY}|secret|{r}|{i}|{other}".encode()).hexdigest() for i in range(len(half) // 64 + 1))
    return "".join(f"{(int(x, 16) + int(y, 16)) % 16:x}" for x, y in zip(half, stream, strict=False))


NATIONAL = {**dict.fromkeys(["1", "7", "30", "52", "57", "86", "90", "91", "92"], range(10, 11)), **dict.fromkeys("31 33 34 41 48 61 66 84 351 380 420 421 966".split(), range(9, 10)), "45": range(8, 9), "47": range(8, 9), "44": range(9, 11), "81": range(9, 11), "55": range(10, 12)}
TWO = {"20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", *map(str, range(51, 59)), *map(str, range(60, 67)), "81", "82", "84", "86", *map(str, range(90, 96)), "98"}


def plain(m):
    """The pseudonym of one match in plain Python."""
    digits = re.sub(r"[^0-9]", "", m)

    def fill(new):
        fresh = iter(new)
        return re.sub("[0-9]", lambda _: next(fresh), m)

    kind = next(k for k, shape in pii.KINDS.items() if regex.search(f"^(?:{shape})$", m))
    if kind == "email":
        return "u" + hashlib.sha256(f"{KEY}|email|{m.lower()}".encode()).hexdigest()[:32] + "@mail.invalid"
    if kind == "secret":
        a, b = m.lower()[: len(m) // 2], m.lower()[len(m) // 2 :]
        for r in range(4):
            a, b = (a, added(b, a, r)) if r % 2 else (added(a, b, r), b)
        return (a + b).upper() if m == m.upper() else a + b
    if kind == "iban":
        w = m.replace(" ", "")
        if mod97(w[4:] + w[:4]) != 1:
            return m
        new = iter(digits_of(re.sub(r"\D", "", w[4:]), KEY, "iban"))
        out = iter(iban(w[:2], re.sub(r"\d", lambda _: next(new), w[4:])))
        return "".join(c if c == " " else next(out) for c in m)
    if kind == "ip":
        q = [int(x) for x in m.split(".")]
        a, b = network(KEY, "ip", q[0] * 256 + q[1], q[2] * 256 + q[3], 65536, 65536)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}" if max(q) < 256 else m
    if kind == "date":
        swapped, day = day_of(m)
        if day is None or not 1900 <= day.year < 2100:
            return m
        new = moved(day)
        return fill(f"{new:%Y%m%d}" if m[:4].isdigit() else f"{new:%m%d%Y}" if swapped else f"{new:%d%m%Y}")
    if kind == "social":
        a, g, s = map(int, m.split("-"))
        if not (0 < a < 900 and a != 666 and g and s):
            return m
        x, y = network(KEY, "social", a - 1 - (a > 666), (g - 1) * 9999 + s - 1, 898, 99 * 9999)
        return f"{x + 1 + (x >= 665):03}-{y // 9999 + 1:02}-{y % 9999 + 1:04}"
    if kind == "card":
        return fill(with_luhn(digits_of(digits[:-1], KEY, "card"))) if 13 <= len(digits) <= 19 and luhn(digits) else m
    code = ""
    if m[0] == "+":
        code = digits[:1] if digits[0] in "17" else digits[:2] if digits[:2] in TWO else digits[:3]
        if len(digits) - len(code) not in NATIONAL.get(code, range(6, 14) if len(code) == 2 else range(5, 13)):
            return m
    return fill(code + digits_of(digits[len(code) :], KEY, "phone"))


def test_whole_texts_match_plain_python(spark, sf):
    found = regex.compile(pii.ANY)
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    rng = random.Random(8)
    some = ["+44 1632 960123", "+49 30 1234567", "+351 912 345 678", "+1 (017) 555-7713", "(030) 1234 5678", "212-555-0147", "10.0.255.1", "DE89 3704 0044 0532 0130 00", "4111-1111-1111-1111", "123-45-6789", "13/31/2001", "12/31/2001", "1999/02/28", "A1" * 20, "x.y@z.example", "+999 123 456", "+1 23", "7"]
    more = [(10_000 + i, "".join(rng.choice(some) + rng.choice([" ", "\n", ", ", "-", " x ", "; 12 "]) for _ in range(12))) for i in range(60)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, KEY).collect()}
    changed = 0
    for r in docs.collect():
        want = found.sub(lambda m: plain(m[0]), r["text"] or "")
        assert (got[r["doc_id"]] or "") == want
        changed += want != r["text"]
    assert changed > 100


def test_a_phone_is_linked_whatever_follows(spark):
    after = ["", " now", " 2024", " 42", ", 42", ". 1999", " (see 12)", " 10.0.0.1", "\n7", " and +1 555 010 0123", "-2024", ".5"]
    for number in ("+1-555-010-0199", "+1 555 010 0199", "+1.555.010.0199", "+15550100199", "+1 (555) 010-0199", "+33 1 23 45 67 89", "+48 123 456 789", "555-010-0199"):
        df = spark.createDataFrame([(i, f"call {number}{a}") for i, a in enumerate(after)], "doc_id int, text string")
        texts = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, KEY).collect()}
        new = texts[0].removeprefix("call ")
        assert new != number and re.sub(r"\d", "", new) == re.sub(r"\d", "", number) and (number[0] != "+" or new[:2] == number[:2])
        kept = [a for a in after if "." not in a[1:] and "+" not in a]
        assert all(texts[i] == f"call {new}{a}" for i, a in enumerate(after) if a in kept)
        assert all(texts[i].startswith(f"call {new}") for i, _ in enumerate(after))
    same = {re.sub(r"\D", "", p)[-10:] for p in mapped(spark, ["+1-555-010-0199", "+1 555 010 0199", "+15550100199", "+1 (555) 010-0199", "555-010-0199", "(555) 010-0199"]).values()}
    assert len(same) == 1


def test_key_is_asked_for():
    import inspect

    assert inspect.signature(pii.pseudonymise).parameters["key"].default is inspect.Parameter.empty
    assert "op4_pii_pseudonyms" in QUERIES
