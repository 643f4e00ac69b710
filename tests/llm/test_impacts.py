import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomquery.llm import impacts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in TERM.findall(t or "")]


def brute(docs, queries, k=20):
    tf = [(d, Counter(terms(t))) for d, t in docs]
    big_n = sum(bool(c) for _, c in tf)
    big_l = sum(sum(c.values()) for _, c in tf)
    df = Counter(w for _, c in tf for w in c)
    asked = {}
    for i, t in set(queries):
        asked.setdefault(i, Counter()).update(terms(t))
    out = Counter()
    for i, q in asked.items():
        found = []
        for d, c in tf:
            n = sum(c.values())
            m = 75 + 25 * n * big_n // big_l if big_l else 75
            s = sum(r * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, r in q.items() if w in c)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += Counter((i, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(found)[:k], 1))
    return out


def run(spark, docs, queries, k=20, parts=3):
    d = spark.createDataFrame(docs, "doc_id long, text string, ids string, term int").repartition(parts)
    index, n = impacts.build(d)
    return Counter(tuple(r) for r in impacts.search(index, n, queries, k).collect())


@pytest.mark.parametrize("k,block,parts", [(20, 256, 1), (3, 4, 5)])
def test_matches_brute_force(spark, monkeypatch, k, block, parts):
    monkeypatch.setattr(impacts, "BLOCK", block)
    rng = random.Random(k)
    vocabulary = [f"W{i}é" if i % 3 else f"v{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(60)], k=n))
    docs = [(i, text(rng.choice([0, 1, 3, 20, 200]))) for i in range(300)]
    docs += [docs[5], docs[5], (None, docs[7][1]), (900, None), (901, "?!"), (902, "w1é " * 20_000)] + [(1000 + i, "tie tie other") for i in range(50)]
    queries = [(i, text(rng.randint(0, 30))) for i in range(12)] + [(50, "TIE"), (51, None), (52, ""), (53, "unknown"), (None, "v0 v3"), (54, "v3 v3 v3 tie"), (54, "v6"), (0, "v9")]
    queries += queries[:2]
    q = spark.createDataFrame(queries, "item_id long, text string").withColumn("q", F.lit("x"))
    got = run(spark, [(*d, "x", 1) for d in docs], q, k, parts)
    assert got == brute(docs, queries, k)
    assert [r[2] for r in sorted((r for r in got if r[0] == 50), key=lambda r: r[1])] == list(range(1000, 1000 + k))


def test_carries_and_slices():
    """Bitwise sums and the best rows equal those of plain integers."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 20, 256), rng.integers(0, 1 << 20, 256)
    sliced = lambda x, n: np.stack([np.packbits(x >> s & 1, bitorder="little").view(np.uint64) for s in range(n)])
    total = sliced(a, 30)
    for bit in (0, 3, 9):
        impacts.add(total, sliced(b, 20), bit)
    want = a + b * (1 + 8 + 512)
    assert (total == sliced(want, 30)).all()
    for k in (1, 20, 300):
        chosen = np.flatnonzero(np.unpackbits(impacts.best(total[:, None], k)[0].view(np.uint8), bitorder="little"))
        assert set(chosen) == set(sorted(range(256), key=lambda i: (-want[i], i))[:k]) - set(np.flatnonzero(want == 0))
    equal = sliced(np.full(256, 5), 4)[:, None]
    assert np.flatnonzero(np.unpackbits(impacts.best(equal, 7)[0].view(np.uint8), bitorder="little")).tolist() == list(range(7))
    bits, starts = impacts._slices(a, np.array([0, 3, 3, 20, 256]))
    for i, (x, y) in enumerate([(0, 3), (3, 3), (3, 20), (20, 256)]):
        back = np.unpackbits(bits[starts[i] : starts[i + 1]].reshape(20, -1), axis=1, bitorder="little")[:, : y - x]
        assert (sum(back[s].astype(np.int64) << s for s in range(20)) == a[x:y]).all()


def test_rows_of_trouble_and_empty_tables(spark, trouble, empty):
    rows = [(r["doc_id"], r["text"]) for r in trouble.collect()]
    queries = [(r[0], r[1]) for r in rows if len(r[1] or "") < 1000] + [(1, "the quick word1x1 ALPHA")]
    q = spark.createDataFrame(queries, "item_id long, text string")
    index, n = impacts.build(trouble)
    assert Counter(tuple(r) for r in impacts.search(index, n, q).collect()) == brute(rows, queries)
    assert impacts.search(index, n, q.limit(0)).count() == 0
    none, n = impacts.build(empty)
    assert n == 0 and impacts.search(none, n, q).count() == 0
    blank, n = impacts.build(trouble.filter("doc_id in (2, 3, 4)"))
    assert n == 0 and impacts.search(blank, n, q).count() == 0
