import random
import re
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from loomquery.llm import common, linededup
from loomquery.llm.queries import QUERIES

M = 2**64 - 1
HAS_WORD = re.compile(r"[^ \t\n\x0b\f\r]")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def cut(lines):
    """Line ranges (from 0, end excluded) of the chunks: of each opening line, from the last one before a closing line to the first such line."""
    le = lambda x: xxhash.xxh64_intdigest(x.encode(), seed=42).to_bytes(8, "little")
    at = [i for i, x in enumerate(lines) if HAS_WORD.search(x)]
    rolling = [xxhash.xxh64_intdigest(le(lines[b]), seed=xxhash.xxh64_intdigest(le(lines[a]), seed=42)) for a, b in zip(at, at[1:], strict=False)]
    out = set()
    for scale in range(linededup.SCALES):
        opened = None
        for k, r in enumerate(rolling):
            if r >> scale & 1:
                opened = k
            if r >> 32 + scale & 1 and opened is not None:
                out.add((at[opened], at[k + 1] + 1))
                opened = None
    return sorted(out)


def removed(rows):
    """(id, text) to its lines and the numbers (from 0) of those that go."""
    seen, where = defaultdict(list), {}
    key = lambda d, t: (d is None, d or 0, signed(xxhash.xxh64_intdigest((t or "").encode(), seed=42)))
    for d, t in set(rows):
        lines = (t or "").split("\n")
        where[d, t] = lines, []
        for a, b in cut(lines):
            seen["\n".join(lines[a:b])].append((key(d, t), a, b, (d, t)))
    for places in seen.values():
        first, *later = sorted(places, key=lambda p: p[:2])
        for _, a, b, doc in later:
            if doc != first[3] or a >= first[2]:
                where[doc][1].append((a, b))
    return {doc: (lines, {i for a, b in gone for i in range(a, b)}) for doc, (lines, gone) in where.items()}


def brute(rows):
    out, gone = Counter(), removed(rows)
    for d, t in rows:
        lines, drop = gone[d, t]
        out[d, len(lines), len(drop), None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in drop)] += 1
    return out


def test_matches_brute_force(spark, trouble, sf):
    passage = "\n".join(f"shared line number {i} of a passage with words" for i in range(14))
    more = spark.createDataFrame([(2000 + i, f"own {i}\nand {i * 7}\n{passage}\nend {i}\n\n\n\nx{i}") for i in range(5)] + [(3000, passage + "\n" + passage)], "doc_id long, text string")
    docs = trouble.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text")).unionByName(more)
    got = Counter(tuple(r) for r in linededup.dedup_lines(docs).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(k[2] for k in got if k[0] and k[0] >= 2000) >= 30


def test_apply(spark, trouble, empty):
    copies = spark.createDataFrame([(i, "\n".join(f"line {j} has words" for j in range(9)), "en", "s", 0, "a", "b", 1) for i in (11, 12)], trouble.schema)
    out = linededup.apply_line_dedup(trouble.unionByName(copies), length_col="n_chars")
    assert out.columns == trouble.columns
    ids = Counter(r["doc_id"] for r in out.collect())
    assert ids[11] == 1 and ids[12] == 0 and ids[1] == 3 and ids[2] == ids[3] == ids[4] == 1
    assert linededup.dedup_lines(empty).count() == 0 and linededup.apply_line_dedup(empty).count() == 0


def repeated_runs(texts):
    """The lines of each text (from 0) in a run of two or more worded lines that stands at an earlier place, from one worded line to another: all pairs of places are compared."""
    places = [(d, i) for d, lines in enumerate(texts) for i in range(len(lines))]
    gone = [set() for _ in texts]
    for q, (d, j) in enumerate(places):
        for c, i in places[:q]:
            n = 0
            while i + n < len(texts[c]) and j + n < len(texts[d]) and (c < d or i + n < j) and texts[c][i + n] == texts[d][j + n]:
                n += 1
            worded = [j + k for k in range(n) if HAS_WORD.search(texts[d][j + k])]
            if len(worded) > 1:
                gone[d] |= set(range(worded[0], worded[-1] + 1))
    return gone


def test_short_passages_go(spark):
    """Fresh passages in two texts go from the second; what goes is inside a repeated run, and nearly all of it goes."""
    rng = random.Random(9)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))
    texts, own, sizes = [], [], []
    for n in (2, 3, 4, 5, 6, 10, 15) * 40:
        passage = [line(rng.randint(26, 40)) for _ in range(n)]
        if n > 2 and rng.random() < 0.5:
            passage[1:1] = [""] * rng.randint(1, 3)
        for _ in range(2):
            before, after = ([line(8) for _ in range(rng.randint(3, 9))] for _ in range(2))
            texts.append([*before, *passage, *after])
            own.append([*before, *after])
            sizes.append(n)
    texts += [["one a", "two b", "one a", "two b", "one a", "two b"], ["x x"] * 3, ["x x"] * 2 + ["y"], ["y y", "", "z z"], ["q", "y y", "", "z z", "", "r"], ["y y", "z z"]]
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    for i, (lines, gone) in enumerate(zip(texts, repeated_runs(texts), strict=True)):
        rest = iter(got[i]["text"].split("\n"))
        assert got[i]["n_removed"] <= len(gone) and all(x in rest for j, x in enumerate(lines) if j not in gone)
    assert all(got[i]["n_removed"] == 0 for i in range(0, len(own), 2))
    share = {n: sum(got[i]["n_removed"] for i in range(1, len(own), 2) if sizes[i] == n) / sum(len(texts[i]) - len(own[i]) for i in range(1, len(own), 2) if sizes[i] == n) for n in set(sizes)}
    assert share[2] > 0.9 and all(v > 0.97 for n, v in share.items() if n > 2), share


def test_nothing_goes_without_chunks(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert linededup.dedup_lines(docs).filter("n_removed > 0").count() > 10
    monkeypatch.setattr(linededup, "_CHUNKS", "cast(array() as array<struct<s: int, e: int>>)")
    assert linededup.dedup_lines(docs).filter("n_removed > 0").count() == 0


def test_registered_query(spark, sf):
    want = brute([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert Counter(tuple(r) for r in QUERIES["op9_line_dedup"](spark, sf).collect()) == want


def test_salted_hot_chunks(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    passage = "\n".join(f"shared line number {i} of a passage with words" for i in range(4))
    docs = docs.select("doc_id", "text").unionByName(spark.range(5000, 5300).select(F.col("id").alias("doc_id"), F.concat(F.lit("own "), F.col("id"), F.lit("\n" + passage + "\nend of "), F.col("id")).alias("text")))
    plain = sorted(tuple(r) for r in linededup.dedup_lines(docs).collect())
    assert sum(r[2] == 4 for r in plain if r[0] >= 5000) == 299
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    assert plain == sorted(tuple(r) for r in linededup.dedup_lines(docs).collect())
