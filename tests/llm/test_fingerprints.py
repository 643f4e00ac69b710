import hashlib
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from loomquery.llm import common, fingerprints

SPACE = " \t\n\x0b\f\r"


def brute(text):
    votes, total = [0] * 64, 0
    for w in text.lower().translate({ord(c): " " for c in SPACE}).split(" "):
        if not w:
            continue
        h, weight = xxhash.xxh64_intdigest(w.encode(), seed=42), max(1, min(len(w), 12) - 2) ** 2
        total += weight
        for j in range(64):
            votes[j] += weight * (h >> j & 1)
    return sum(1 << j for j in range(64) if votes[j] > total / 2)


def test_matches_brute_force(spark, trouble, sf):
    few = spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text").filter("doc_id < 1040")
    docs = trouble.select("doc_id", "text").filter("doc_id is null or doc_id <> 8").unionByName(few)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    signed = lambda t: xxhash.xxh64_intdigest(t.encode(), seed=42) - (1 << 64) * (xxhash.xxh64_intdigest(t.encode(), seed=42) >> 63)
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, signed(r[1])))
    follows = {r: order[(i + 1) % len(order)] for i, r in enumerate(order)}
    fps = {r: brute(r[1]) for r in set(rows)}
    group = dict.fromkeys(fps.values())
    for start in group:
        if group[start] is None:
            reached, edge = {start}, [start]
            while edge:
                x = edge.pop()
                new = {y for y in group if y not in reached and bin(x ^ y).count("1") <= fingerprints.RADIUS}
                reached |= new
                edge += new
            least = min((i for (i, _), fp in fps.items() if fp in reached and i is not None), default=None)
            group |= dict.fromkeys(reached, (least,))
    n_links = {fp: sum(bin(fp ^ fps[r]).count("1") <= fingerprints.RADIUS for r in rows) - 1 for fp in group}
    want = Counter()
    for i, t in rows:
        nxt, k = follows[(i, t)][1], len(t) // 2
        edited = t[: len(t) - k] + nxt[:k]
        a, b, c = brute(t), brute(edited), brute(nxt)
        alike = lambda x, y: 1 - bin(x ^ y).count("1") / 64
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", alike(a, b), alike(a, c), group[a][0], n_links[a])] += 1
    assert Counter(tuple(r) for r in fingerprints.fingerprint(docs).collect()) == want


def test_edge_cases(spark, trouble, empty):
    got = fingerprints.fingerprint(trouble).collect()
    assert len(got) == 13 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["fingerprint"], set()).add(r["near_group"])
    assert all(len(g) == 1 for g in by.values())
    assert fingerprints.fingerprint(empty).count() == 0
    one = fingerprints.fingerprint(trouble.filter("doc_id = 6")).collect()[0]
    assert one["near_next"] == 1.0 and one["n_chars"] == 13


def test_links_of_a_cloud_are_counted(spark):
    """Fingerprints around one centre and far ones, with weights: by pairs and by the linear way."""
    rng = random.Random(6)
    centre, rows = rng.getrandbits(64), []
    for i in range(400):
        x = centre if i < 330 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << b
        rows += [(i, x - (1 << 64) if x >> 63 else x)] * rng.choice([1, 1, 3])
    fps = common.save(spark.createDataFrame(rows, "doc_id long, fp long"))
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 4
    want = {fp: sum(near(fp, other) for _, other in rows) - 1 for _, fp in rows}
    for hot in (fingerprints.HOT, 100, 8):
        assert {r["fp"]: r["n_links"] for r in fingerprints.near_groups(fps, hot=hot).collect()} == want


def test_a_text_beyond_the_sums_raises(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "MOST", 1000)
    short, long = (spark.createDataFrame([(1, t)], "doc_id long, text string") for t in ("few words here", "somewhat-longer-words " * 11))
    assert fingerprints.simhash(short, ["doc_id"]).count() == 1 and fingerprints.simhash(short, ["doc_id"]).first()["fp"] is not None
    with pytest.raises(Exception, match="too long"):
        fingerprints.simhash(long, ["doc_id"]).collect()
