import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from loomquery.llm import common, graph, neardup


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def roots(items, linked):
    up = {x: x for x in items}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if linked(a, b):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in items}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1") <= 4


def test_matches_brute_force(spark, trouble, sf):
    docs = trouble.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    rows = docs.collect()
    fps = {r: brute_fp(r["text"]) for r in set(rows)}
    comp = roots(sorted(set(fps.values())), near)
    least = {}
    for r in rows:
        c = comp[fps[r]]
        least[c] = min((x for x in (least.get(c), r["doc_id"]) if x is not None), default=None)
    want = Counter((r["doc_id"], f"{fps[r]:016x}", least[comp[fps[r]]]) for r in rows)
    assert Counter(tuple(r) for r in neardup.near_duplicates(docs).collect()) == want


def test_links_in_a_cloud_by_either_way(spark):
    """Fingerprints around one centre, far ones among them: the linear way finds the same components."""
    rng = random.Random(5)
    centre, values = rng.getrandbits(64), set()
    for _ in range(160):
        x = centre
        for b in rng.sample(range(64), rng.randint(0, 9)):
            x ^= 1 << b
        values.add(x)
    values |= {rng.getrandbits(64) for _ in range(40)}
    items = sorted(signed(v) for v in values)
    want = {x: r for x, r in roots(items, near).items()}
    fps = common.save(spark.createDataFrame([(x,) for x in items], "fp long"))
    for hot in (neardup.HOT, 8):
        found = {r["v"]: r["root"] for r in graph.components(neardup.links(fps, len(items), hot=hot)).collect()}
        assert {x: found.get(x, x) for x in items} == want


def test_more_blocks_for_more_fingerprints():
    assert neardup.blocks_for(1000) == 6 and neardup.blocks_for(2**30) > neardup.blocks_for(2**20)
    for n in (1000, 2**23, 2**31):
        m = neardup.blocks_for(n)
        masks = neardup.block_masks(m)
        flips = sum(1 << (64 * i // m) for i in range(4))  # one bit in each of four blocks
        assert any(flips & mask == 0 for mask in masks)


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    for find in (graph.components, graph.contracted_components):
        got = {r["v"]: r["root"] for r in find(edges).collect()}
        assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
        assert find(edges.limit(0)).count() == 0


def test_dense_components(spark):
    rng = random.Random(9)
    pairs = sorted({tuple(rng.sample(range(g * 100, g * 100 + 40), 2)) for g in range(5) for _ in range(120)})
    edges = spark.createDataFrame(pairs, "a long, b long")
    a, b = ({(r["v"], r["root"]) for r in f(edges).collect()} for f in (graph.components, graph.contracted_components))
    linked = {frozenset(p) for p in pairs}
    want = roots(sorted({x for p in pairs for x in p}), lambda x, y: frozenset((x, y)) in linked)
    assert a == b == set(want.items())


def test_one_of_each_group_stays(spark, trouble, empty):
    kept = neardup.drop_near_duplicates(trouble)
    assert kept.columns == trouble.columns
    groups = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in neardup.near_duplicates(trouble).collect()}
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x or 0))
    assert len(ids) == len({c for c in groups.values()}) and len(set(ids)) == len(ids)
    assert 6 in ids and 7 not in ids and 2 in ids and 3 not in ids
    assert neardup.near_duplicates(empty).count() == 0 and neardup.drop_near_duplicates(empty).count() == 0


def test_text_ids_and_equal_rows(spark):
    body = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([("b", body), ("a", body), ("a", body), ("c", "other words here now")], "doc_id string, text string")
    groups = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert groups == {("a", "a"), ("b", "a"), ("c", "c")}
    assert sorted(r["doc_id"] for r in neardup.drop_near_duplicates(docs).collect()) == ["a", "c"]


def test_rows_of_one_id_and_text_keep_the_same_one(spark):
    """Which row stays doesn't depend on the order of rows."""
    rows = [(1, "one and the same text", lang, source) for lang in ("en", None) for source in ("a", "b", "c", None)] + [(2, "quite another text here", "en", "a")]
    kept = set()
    for seed in range(4):
        some = sorted(rows, key=lambda r: hash((seed, r)))
        docs = spark.createDataFrame(some, "doc_id long, text string, lang string, source string").repartition(seed + 1)
        kept.add(tuple(sorted(map(str, neardup.drop_near_duplicates(docs).collect()))))
    assert len(kept) == 1 and len(next(iter(kept))) == 2


def test_salted_ways_agree(spark, sf, monkeypatch):
    """Hot groups dealt by salts, and marks too many to broadcast, change no row."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.filter("doc_id = 3").withColumn("doc_id", F.explode(F.sequence(F.lit(10_000), F.lit(10_400)))))
    plain = [sorted(map(str, f(docs).collect())) for f in (neardup.near_duplicates, neardup.drop_near_duplicates)]
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_SHARE", 10_000)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    assert plain == [sorted(map(str, f(docs).collect())) for f in (neardup.near_duplicates, neardup.drop_near_duplicates)]
