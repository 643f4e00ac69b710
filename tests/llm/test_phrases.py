import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomquery.llm import phrases
from loomquery.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, bench, window=10):
    items = {}
    for i, t in set(bench):
        w = words(t)
        size = min(window, len(w))
        items.setdefault("null" if i is None else str(i), set()).update(tuple(w[k : k + size]) for k in range(len(w) - size + 1) if w)
    out = Counter()
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, wins in items.items():
            for win in wins:
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        found.add(i)
        out[d, len(w), len(hit), len(found), tuple(sorted(found)), bool(hit)] += 1
    return out


def told(df):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"]), r["contaminated"]) for r in df.collect())


@pytest.fixture(scope="module")
def small():
    """Few words, so that windows overlap, repeat within a text, and share words and items."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice(["Aa", "b", "ç9", "dd", "É"]) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    bench = [(i % 9, text(rng.choice([0, 1, 2, 3, 4, 5, 7]))) for i in range(14)] + [(None, text(4)), (77, "nowhere at all"), (78, None), (79, "?!")]
    bench += bench[:2] + [(100 + i, docs[i][1]) for i in range(0, 60, 7)]
    docs += [docs[0], docs[0], (None, docs[1][1]), (500, None), (501, ""), (502, " \t?"), (503, docs[2][1] * 400)]
    return docs, bench


@pytest.mark.parametrize("window,block", [(3, 20_000), (10, 2)])
def test_matches_brute_force(spark, small, monkeypatch, window, block):
    """The second case deals the tests over many groups of a segment."""
    monkeypatch.setattr(phrases, "BLOCK", block)
    docs, bench = small
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit(1)).withColumn("segment", F.lit("x")).repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("term", F.lit("x"))
    assert told(phrases.contamination(d, b, window)) == brute(docs, bench, window)


def test_near(spark, small):
    docs, _ = small
    asked = [("a", "aa b ç9"), ("b", "é dd"), ("c", "b b"), ("d", "aa nowhere"), ("e", "dd")]
    found = phrases.near(phrases.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)), phrases.tests(spark.createDataFrame(asked, "item_id string, text string")), 4)
    index = phrases.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    found = phrases.near(index, phrases.tests(spark.createDataFrame(asked, "item_id string, text string")), 4).join(phrases.documents(index), ["segment", "ord"])
    got = Counter((r["doc_id"], r["n_words"], r["item"], r["at"], r["n"]) for r in found.collect())
    want = Counter()
    for d, t in docs:
        w = words(t)
        for i, q in asked:
            need = set(words(q))
            spans = [(a, a + n) for n in range(1, 5) for a in range(len(w) - n + 1) if need <= set(w[a : a + n])]
            # the shortest ones: none holds another
            want += Counter((d, len(w), i, a, b - a) for a, b in spans if not any((x, y) != (a, b) and a <= x and y <= b for x, y in spans))
    assert got == want and sum(got.values()) > 100


def test_lists(spark):
    assert phrases.exact([np.array([1, 5, 9]), np.array([2, 3, 10]), np.array([0, 3, 4])]).tolist() == [1]
    assert phrases.spans([np.array([1, 20]), np.array([3, 30])], 2)[0].tolist() == []
    assert [x.tolist() for x in phrases.spans([np.array([1, 20]), np.array([3, 19])], 3)] == [[1, 19], [3, 20]]


def test_rows_of_trouble_and_empty_tables(spark, trouble, empty):
    bench = trouble.select(F.col("doc_id").alias("item_id"), "text", "lang", "n_chars")
    rows, items = [(r["doc_id"], r["text"]) for r in trouble.collect()], [(r["item_id"], r["text"]) for r in bench.collect()]
    short = [r for r in items if r[1] is None or len(r[1]) < 1000]
    got = told(phrases.contamination(trouble, spark.createDataFrame(short, "item_id long, text string")))
    assert got == brute(rows, short)
    assert phrases.contamination(empty, bench).count() == 0
    none = phrases.contamination(trouble, empty.select(F.col("doc_id").alias("item_id"), "text"))
    assert none.count() == trouble.count() and none.filter("contaminated or n_hit > 0 or n_items > 0").count() == 0
    # a whole document as a test of itself: every word is hit
    long = phrases.contamination(trouble.filter("doc_id = 5"), bench.filter("item_id = 5")).first()
    assert long["n_hit"] == long["n_words"] == 30_000


def test_index_covers_every_word(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    index = phrases.build(docs)
    got = {bytes(r["term"]).decode(): r["n"] for r in index.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    assert got == Counter(w for r in docs.collect() for w in words(r["text"]))


def test_query(spark, sf):
    rows = QUERIES["op11_decontamination"](spark, sf).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(d, n, h, k, hashlib.sha256(",".join(items).encode()).hexdigest(), c) for d, n, h, k, items, c in brute(docs, bench)}
    assert {tuple(r) for r in rows} == want and any(r["contaminated"] for r in rows)
