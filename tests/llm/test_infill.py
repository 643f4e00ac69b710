import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomquery.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, unit="token"):
    text = text or ""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    n, h = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


ALPHABET = " \t\n\r\x0b\x0cab<PSM>é€😀  "


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**12), st.text(st.sampled_from(ALPHABET), max_size=60), st.sampled_from(["token", "char"]))
def test_cuts_and_round_trips(doc_id, text, unit):
    n, form, output, prefix, middle = infill.transform(doc_id, text.encode(), unit=unit)
    assert (n, form, prefix, middle, output.decode()) == brute(doc_id, text, unit)
    assert infill.restore(output, form).decode() == text


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=40))
def test_every_cut(text):
    for unit, units in (("token", TOKEN.findall(text)), ("char", list(text))):
        runs = infill.Runs(text.encode(), unit)
        assert runs.n == len(units)
        for u in range(runs.n + 1):
            before = "".join(units[:u])
            assert runs.cut(u) == (len(before.encode()), len(before))


def told(df):
    return Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in df.collect())


@pytest.mark.parametrize("unit", ["token", "char"])
def test_rows_of_trouble_and_empty_tables(spark, trouble, empty, unit):
    rng = random.Random(1)
    more = [(i, "".join(rng.choices(ALPHABET, k=rng.randint(0, 50))), "en", "s", 1, "x", "y", 7) for i in range(100, 200)]
    docs = trouble.unionByName(spark.createDataFrame([*more, (200, "word é " * 200_000, None, None, None, None, None, None)], trouble.schema))
    out = infill.infill(docs.withColumnRenamed("kept", "form"), unit=unit)
    assert told(out) == Counter((r["doc_id"], *brute(r["doc_id"], r["text"], unit)) for r in docs.collect())
    back = Counter((r["doc_id"], r["restored"]) for r in out.collect())
    assert back == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert infill.infill(empty).count() == 0


def test_rates(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'one two three four' as text")
    forms = Counter(r["form"] for r in infill.infill(docs, rate=30, spm_rate=10).collect())
    assert 1000 < forms["psm"] + forms["spm"] < 1400 and forms["spm"] < forms["psm"] / 5
    assert infill.infill(docs, seed=7).join(infill.infill(docs), "doc_id").count() == 4000
    ids = spark.createDataFrame([("a", "x y"), (None, "x y")], "doc_id string, text string")
    assert {r["doc_id"]: r["restored"] for r in infill.infill(ids, rate=100).collect()} == {"a": "x y", None: "x y"}
