import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomquery.llm import common, mixing


def brute(rows):
    """(doc_id, size, source_size, target, taken) by a sort of hashes."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    total = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, budget = {}, 1.5 * sum(total.values())
    while True:
        free = [s for s in sources if s not in target]
        if not free:
            break
        rest, w = budget - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > 2 * total[s]]
        if not over:
            target |= {s: rest * weight[s] / w for s in free}
            break
        target |= {s: 2.0 * total[s] for s in over}
    key = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    out = []
    for s in sources:
        docs = sorted((r for r in rows if r[2] == s), key=lambda r: key(r[0]))
        copies = int(target[s] // total[s]) if total[s] else 0
        left = int(target[s]) - copies * total[s]
        by = Counter()
        for r in docs:
            by[key(r[0])] += size(r[1])
        cum, cut = 0, None
        for h in sorted(by):
            if cum + by[h] > left:
                cut = (h, left - cum)
                break
            cum += by[h]
        for r in docs:
            n, h = size(r[1]), key(r[0])
            extra = 0 if cut is None else n if h < cut[0] else int(cut[1] * (n / by[h])) if h == cut[0] else 0
            out.append((r[0], n, total[s], target[s], copies * n + extra))
    return out


def close(got, want):
    k = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[4])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=k), sorted(want, key=k), strict=True):
        assert a[:3] == b[:3] and a[4] == b[4] and a[3] == pytest.approx(b[3])


def test_matches_brute_force(spark, trouble, sf):
    for docs in (trouble.select("doc_id", "text", "source"), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")):
        got = [tuple(r) for r in mixing.mix(docs).collect()]
        close(got, brute([tuple(r) for r in docs.collect()]))
        assert sorted(map(repr, got)) == sorted(map(repr, (tuple(r) for r in mixing.mix(docs.repartition(7)).collect())))


def test_sources_reach_their_targets(spark, sf):
    got = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source"))))
    by = got.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r["t"] - r["target"]) < 2 for r in by)
    assert got.filter("taken > 2 * size").count() == 0


def test_apply_repeats_rows(spark, trouble, empty):
    out = mixing.apply_mix(trouble)
    assert out.columns == trouble.columns
    assert out.groupBy("doc_id", "text", "source").count().filter("count > 6").count() == 0
    assert out.filter("text is null or trim(text) = ''").count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0


def test_large_lookup_is_salted(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    big = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    small = common.save(big.groupBy("k").agg(F.count("*").alias("n")))
    got = common.lookup(big, small, "k", F.col("id"))
    assert got.count() == 1000 and got.filter("n is null").count() == 0


def test_global_scan(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = common.global_scan(df, [F.col("x")], {"cum": "x"}).orderBy("x").collect()
    cum = 0
    for i, r in enumerate(got, 1):
        cum += r["x"]
        assert r["_lq_rank"] == i and r["cum"] == cum
