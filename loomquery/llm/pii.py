"""4. Format-preserving pseudonyms for personal data.

Validated numbers and dates are permuted within their format by a keyed Feistel network, so equal values
get equal pseudonyms in every document and different values different ones:

* card numbers (13 to 19 digits with a right Luhn digit): all but the last digit, which is computed anew;
* bank accounts (IBAN, right by mod 97): the digits of the account, the check digits anew;
* social numbers (area, group and serial in their ranges): within those ranges;
* phone numbers: the national digits; separators and country code are kept. A number with ``+`` needs a country code by
  the numbering plan and as many digits as its country has, its groups joined by one kind of separator, so that a number
  ends where its plan says, whatever number follows; without ``+`` three groups of fixed sizes or an area in parentheses.
  (A country with several lengths takes the longest that fits: only there, and only where the same separator
  stands between, may a following number be taken for a last group.)
* dates (a real calendar day of 1900 to 2099, also before a time): one permutation of days for all formats,
  so one day stays one day in every format. Days up to the 12th and later days are permuted apart: a day
  written month first is known by a day over 12, and its pseudonym must be too;
* IPv4 addresses (four numbers up to 255): permuted among 32-bit addresses;
* hexadecimal secrets (24 digits or more): a Feistel network on the halves of the whole string, of any length.

E-mail addresses have no number to permute: the name becomes a keyed digest of 128 bits, the host is fixed.
What only looks like one of these stays: a wrong Luhn or mod-97 check, bare digits of other lengths, month 13,
300.1.1.1, area 000.

Networks on ranges have no cycle walk but for the later days, where some places are no day (30 February): a
walk goes on until it finds one, at most as many steps as the key's longest walk, which is computed exactly.

The key is the caller's secret: who has it can undo what the networks do.

Everything is an expression on the row: no shuffle, no Python. A text without a digit or ``@`` is passed on.

Defined results: null text stays null with no replacement; empty and blank texts stay as they are. Very long
texts are taken whole. Repeated rows give equal results. Only id and text are read, whatever other columns
there are. Empty tables give no rows.
"""

from __future__ import annotations

from datetime import date
from functools import cache
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

_B, _E = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Country codes of the numbering plan with one and with two digits (all others have three); national digits of some countries.
_CODE = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|5[09]|6[7-9]|8[0578]|9[679])\d)"
_NATIONAL = {"1": (10, 10), "7": (10, 10), "31|33|34|41|48|61|66|84": (9, 9), "30|52|57|86|90|91|92": (10, 10), "45|47": (8, 8), "351|380|420|421|966": (9, 9), "44|81": (9, 10), "55": (10, 11)}
#: National digits elsewhere, for codes of two and of three digits: at most 15 with the code.
_ELSEWHERE = {2: (6, 13), 3: (5, 12)}


def _national(apart: str, least: int, most: int) -> str:
    return rf"\d(?:{apart}?\d){{{least - 1},{most - 1}}}"


def _phones() -> str:
    """How phone numbers look: with country code, with an area in parentheses, or as three, three and four digits."""
    known = "|".join(_NATIONAL)
    codes = [(f"(?:{c})", *n) for c, n in _NATIONAL.items()] + [(rf"(?!{known}){_CODE}(?<=\+\d{{{k}}})", *n) for k, n in _ELSEWHERE.items()]
    whole = [rf"\+{code}[ .-]?{_national(apart, *n)}" for apart in ("-", r"\.", " ") for code, *n in codes]
    area = rf"(?:\+{_CODE}[ .-]?)?\(\d{{2,4}}\)[ .-]?\d{{3,4}}[ .-]?\d{{3,4}}"
    return rf"(?<![\p{{L}}\p{{N}}+])(?:{'|'.join([*whole, area])}){_E}|{_B}\d{{3}}[.-]\d{{3}}[.-]\d{{4}}{_E}"


#: How each kind looks, in the order in which they are tried.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": _B + r"(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{24,}" + _E,
    "iban": _B + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _E,
    "ip": r"(?<![\p{L}\p{N}.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\p{L}\p{N}]|\.\d)",
    "date": _B + r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})(?=T\d\d:|[^\p{L}\p{N}]|$)",
    "phone": _phones(),
    "social": _B + r"\d{3}-\d{2}-\d{4}" + _E,
    "card": _B + r"\d(?:[ -]?\d){12,18}" + _E,
}
ANY = "|".join(KINDS.values())

#: Years of dates; days of a month up to the 12th, and places for the later ones (13 to 31).
FIRST_YEAR, YEARS, EARLY, LATE = 1900, 200, 12, 19
#: The two ranges of days as rectangles: 200 * 12 * 12 places, all of them days, and 200 * 12 * 19.
_EARLY_SIDES, _LATE_SIDES = (160, 180), (200, 228)


def _mix(key: str, tag: Column, r: Column, half: Column) -> Column:
    """A keyed number below 2^60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tag, r.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")


def _feistel(key: str, tag: Column | str, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """Struct (a, b): the pair permuted within [0, size_a) x [0, size_b)."""
    tag = F.lit(tag) if isinstance(tag, str) else tag

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["a"] + F.pmod(_mix(key, tag, r, s["b"]), size_a), size_a)).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + F.pmod(_mix(key, tag, r, s["a"]), size_b), size_b)).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permuted_digits(digits: Column, key: str, tag: str = "digits") -> Column:
    """A string of 2 to 30 digits permuted among the strings of its length; others stay."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    a, b = F.substring(digits, F.lit(1), left).try_cast("long"), F.substring(digits, left + 1, n).try_cast("long")
    permuted = _feistel(key, F.concat(F.lit(tag), n.cast("string")), a, b, _power(left), _power(n - left))
    out = _let(permuted, lambda p: F.concat(F.lpad(p["a"].cast("string"), left, F.lit("0")), F.lpad(p["b"].cast("string"), n - left, F.lit("0"))))
    return F.when(n.between(2, 30), out).otherwise(digits)


def luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string modulo 10 (0: valid)."""
    places = F.transform(F.split(F.reverse(digits), "", -1), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    return F.aggregate(places, F.lit(0), lambda a, d: a + d) % 10


def _refill(shape: Column, digits: Column) -> Column:
    """The digits of ``shape`` replaced by ``digits`` in order."""
    gaps = F.split(shape, "[0-9]", -1)
    return _let(digits, lambda d: F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.substring(d, i + 1, F.lit(1)))), ""))


def _card(m: Column, digits: Column, key: str) -> Column:
    body = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    new = _let(body, lambda d: F.concat(d, F.pmod(10 - luhn(F.concat(d, F.lit("0"))), F.lit(10)).cast("string")))
    return F.when(F.length(digits).between(13, 19) & (luhn(digits) == 0), _refill(m, new)).otherwise(m)


def _mod97(text: Column) -> Column:
    """A string of capitals and digits as the number that its characters (A: 10 to Z: 35) make, modulo 97."""
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(F.split(text, "", -1), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def _iban(m: Column, key: str) -> Column:
    plain = F.translate(m, " ", "")
    head, tail = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    right = (_mod97(F.concat(tail, F.substring(plain, 1, 4))) == 1) & F.substring(plain, 3, 2).cast("int").between(2, 98)
    new = _refill(tail, permuted_digits(F.regexp_replace(tail, "[^0-9]", ""), key, "iban"))
    whole = _let(new, lambda t: F.concat(head, F.lpad((98 - _mod97(F.concat(t, head, F.lit("00")))).cast("string"), 2, "0"), t))

    def spaced(w: Column) -> Column:
        """The characters of ``w`` with the blanks of the match back in their places."""
        kept = lambda a, c: F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i"))
        taken = lambda a: F.struct(F.concat(a["s"], F.substring(w, a["i"], F.lit(1))).alias("s"), (a["i"] + 1).alias("i"))
        start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
        return F.aggregate(F.split(m, "", -1), start, lambda a, c: F.when(c == " ", kept(a, c)).otherwise(taken(a)))["s"]

    return F.when(right, _let(whole, spaced)).otherwise(m)


def _social(m: Column, digits: Column, key: str) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""
    part = lambda at, n: F.substring(digits, at, n).try_cast("long")
    area, group, serial = part(1, 3), part(4, 2), part(6, 4)
    p = _feistel(key, "social", area - 1 - (area > 666).cast("long"), (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"))
    pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    new = _let(p, lambda s: F.concat_ws("-", pad(s["a"] + 1 + (s["a"] >= 665).cast("long"), 3), pad(F.floor(s["b"] / 9999) + 1, 2), pad(s["b"] % 9999 + 1, 4)))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), new).otherwise(m)


def _place(key: str, tag: str, x: int, sides: tuple[int, int]) -> int:
    """What _feistel makes of one place of a rectangle."""
    s = [x // sides[1], x % sides[1]]
    for r in range(ROUNDS):
        mixed = int(sha256(f"{key}|{tag}|{r}|{s[1 - r % 2]}".encode()).hexdigest()[:15], 16)
        s[r % 2] = (s[r % 2] + mixed % sides[r % 2]) % sides[r % 2]
    return s[0] * sides[1] + s[1]


def _is_late_day(x: int) -> bool:
    try:
        return bool(date(FIRST_YEAR + x // (12 * LATE), x // LATE % 12 + 1, x % LATE + EARLY + 1))
    except ValueError:
        return False


@cache
def _late_walk(key: str) -> int:
    """The most steps that any later day needs to reach another one: one, and the longest run of places that are no day."""
    off = {x: _place(key, "late", x, _LATE_SIDES) for x in range(YEARS * 12 * LATE) if not _is_late_day(x)}
    longest = 0
    for x in set(off) - set(off.values()):  # runs start behind a day
        n = 0
        while x in off:
            x, n = off[x], n + 1
        longest = max(longest, n)
    return longest + 1


def _day(m: Column) -> tuple[Column, Column]:
    """Format and calendar day of a date-like string; null if it isn't a day."""
    slashed = F.when(F.substring(m, 4, 2).try_cast("int") > 12, "MM/dd/yyyy").otherwise("dd/MM/yyyy")
    year_first = F.when(m.rlike(r"^\d{4}-"), "yyyy-MM-dd").when(m.rlike(r"^\d{4}/"), "yyyy/MM/dd")
    form = year_first.when(F.contains(m, F.lit(".")), "dd.MM.yyyy").when(F.contains(m, F.lit("/")), slashed).otherwise("dd-MM-yyyy")
    part = lambda name, width: F.substring(m, F.instr(form, F.lit(name)), F.lit(width))
    return form, F.try_to_date(F.concat_ws("-", part("yyyy", 4), part("MM", 2), part("dd", 2)), "yyyy-MM-dd")


def _date(m: Column, key: str) -> Column:
    form, day = _day(m)
    month = (F.year(day) - FIRST_YEAR) * 12 + F.month(day) - 1

    def permuted(tag: str, x: Column, sides: tuple[int, int]) -> Column:
        return _let(_feistel(key, tag, F.floor(x / sides[1]), x % sides[1], F.lit(sides[0]).cast("long"), F.lit(sides[1]).cast("long")), lambda s: s["a"] * sides[1] + s["b"])

    def day_at(x: Column, width: int, first: int) -> Column:
        """The day at a place, null if there is none."""
        month_at = F.floor(x / width)
        two = lambda n: F.lpad(n.cast("string"), 2, "0")
        return F.try_to_date(F.concat_ws("-", (F.floor(month_at / 12) + FIRST_YEAR).cast("string"), two(month_at % 12 + 1), two(x % width + first)), "yyyy-MM-dd")

    early = day_at(permuted("early", month * EARLY + F.dayofmonth(day) - 1, _EARLY_SIDES), EARLY, 1)
    start = F.struct((month * LATE + F.dayofmonth(day) - EARLY - 1).cast("long").alias("x"), F.lit(None).cast("date").alias("d"))
    step = lambda s, _: F.when(s["d"].isNotNull(), s).otherwise(_let(permuted("late", s["x"], _LATE_SIDES), lambda y: F.struct(y.alias("x"), day_at(y, LATE, EARLY + 1).alias("d"))))
    late = F.aggregate(F.sequence(F.lit(1), F.lit(_late_walk(key))), start, step)["d"]

    def digits(new: Column) -> Column:
        later = F.when(form.startswith("MM"), F.date_format(new, "MMddyyyy")).otherwise(F.date_format(new, "ddMMyyyy"))
        return F.when(form.startswith("yyyy"), F.date_format(new, "yyyyMMdd")).otherwise(later)

    inside = F.year(day).between(FIRST_YEAR, FIRST_YEAR + YEARS - 1)
    return F.when(inside, _let(F.when(F.dayofmonth(day) <= EARLY, early).otherwise(late), lambda new: _refill(m, digits(new)))).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    q = F.transform(F.split(m, r"\.", -1), lambda x: x.try_cast("int"))
    p = _feistel(key, "ip", q[0] * 256 + q[1], q[2] * 256 + q[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"))
    out = _let(p, lambda s: F.concat_ws(".", F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256))
    return F.when(F.forall(q, lambda x: x < 256), out).otherwise(m)


def _secret(m: Column, key: str) -> Column:
    """Hexadecimal digits of any number: each half in turn is added to a keyed stream of the other. Case counts as style, not value."""
    n = F.length(m)
    low = F.lower(m)
    halves = F.struct(F.substring(low, F.lit(1), F.floor(n / 2).cast("int")).alias("a"), F.substring(low, F.floor(n / 2).cast("int") + 1, n).alias("b"))

    def stream(other: Column, r: Column, length: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(length / 64).cast("int"))
        return F.array_join(F.transform(blocks, lambda i: F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), r.cast("string"), i.cast("string"), other), 256)), "")

    def added(half: Column, other: Column, r: Column) -> Column:
        number = lambda c: F.conv(c, 16, 10).cast("int")
        digits, keyed = F.split(half, "", -1), F.split(F.substring(stream(other, r, F.length(half)), F.lit(1), F.length(half)), "", -1)
        return F.array_join(F.zip_with(digits, keyed, lambda x, y: F.lower(F.hex((number(x) + number(y)) % 16))), "")

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(F.when(even, added(s["a"], s["b"], r)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(added(s["b"], s["a"], r)).alias("b"))

    out = _let(F.aggregate(F.sequence(F.lit(0), F.lit(3)), halves, step), lambda s: F.concat(s["a"], s["b"]))
    return F.when(m == F.upper(m), F.upper(out)).otherwise(out)


def _phone(m: Column, digits: Column, key: str) -> Column:
    """The national digits permuted alike with and without a country code."""
    code = F.regexp_extract(m, rf"^\+({_CODE})", 1)
    own = F.substring(digits, F.length(code) + 1, F.length(digits))
    bounds = [(F.regexp_like(code, F.lit(f"^(?:{c})$")), n) for c, n in _NATIONAL.items()] + [(F.length(code) == k, n) for k, n in _ELSEWHERE.items()]
    fits = F.lit(True)
    for of, (least, most) in reversed(bounds):
        fits = F.when(of, F.length(own).between(least, most)).otherwise(fits)
    return F.when(fits, _refill(m, F.concat(code, permuted_digits(own, key, "phone")))).otherwise(m)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of ANY; the match itself if it isn't valid."""
    full = lambda k: m.rlike("^(?:" + KINDS[k] + ")$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    address = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 32), F.lit("@mail.invalid"))
    return (
        F.when(full("email"), address)
        .when(full("secret"), _secret(m, key))
        .when(full("iban"), _iban(m, key))
        .when(full("ip"), _ip(m, key))
        .when(full("date"), _date(m, key))
        .when(full("social"), _social(m, digits, key))
        .when(full("card"), _card(m, digits, key))
        .when(full("phone"), _phone(m, digits, key))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_replaced, text."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    some = F.col("text").rlike("[0-9@]")
    df = df.withColumn("m", F.when(some, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("p", F.transform("m", lambda x: pseudonym(x, key)))
    woven = F.array_join(F.transform(F.split("text", ANY, -1), lambda g, i: F.concat(g, F.coalesce(F.get("p", i), F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("m", "p", lambda a, b: a != b), lambda x: x))
    return df.select(F.col("doc_id").alias(id_col), F.coalesce(changed, F.lit(0)).cast("long").alias("n_replaced"), F.when(F.size("m") > 0, woven).otherwise(F.col("text")).alias(text_col))
