import hashlib
import random
import sys
from collections import Counter, defaultdict
from math import comb
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomquery.llm import common, quality
from loomquery.llm.queries import ORACLES, QUERIES, tokenizer_path

sys.path.insert(0, str(Path(__file__).parent))
from test_linededup import removed  # noqa: E402
from test_neardup import brute_fp, near, roots  # noqa: E402
from test_quality import WORD, base  # noqa: E402


def test_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.save(stage(spark, docs, sf), name)
        assert out.columns == docs.columns and out.count() > 0
        if name in ("quality_rules", "near_dedup"):
            assert out.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0 and out.count() <= docs.count()
        if name == "near_dedup":
            assert out.groupBy("doc_id").count().filter("count > 1").count() == 0
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().join(docs.select("doc_id").distinct(), "doc_id").count() == docs.select("doc_id").distinct().count()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sum(r["length"] for r in whole) == sum(r["length"] for r in packed.collect())
    assert {key(r)[0] for r in whole} == {key(r)[0] for r in packed.collect()}


def test_queries_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(ORACLES) <= set(QUERIES)


def test_n_chars_follow(spark, sf):
    out = corpus_pipeline.line_dedup(spark, common.table(spark, sf, "documents"), sf)
    assert out.filter(F.length("text") != F.col("n_chars")).count() == 0


def corpus():
    """Clean texts, junk, too short ones, shared passages, copies and near copies, in two languages and three sources."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    line = lambda n=12: " ".join(word() for _ in range(n))
    passage, rows = [line(20) for _ in range(3)], []
    for i in range(220):
        lang, source = rng.choice(["en", "en", "de"]), rng.choice(["a", "b", None])
        lines = [line() for _ in range(rng.randint(6, 9))]
        kind = i % 10
        if kind == 0:
            lines = [x.replace(" ", "%%% ") for x in lines]
        if kind == 1:
            lines = lines[:2]
        if kind in (2, 3):
            lines[2:2] = passage
        text = "\n".join(lines)
        if kind == 4 and i > 10:
            text = rows[-8][1]
        if kind == 5 and i > 10:
            text = rows[-8][1].replace("\n", " ").upper()
        rows.append((i, text, lang, source, len(text)))
    rows += [(900, None, "en", "a", None), (901, "", None, "b", 0), (None, rows[77][1], "en", "a", 5)]
    marks = [(i, 0 if i % 10 in (0, 5) else 1, 0) for i in range(220)]
    return rows, marks


def level(text):
    n_words, word_chars, n_symbols, n_dup, n_repeat = base(text)
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    length = word_chars / max(n_words, 1)
    value = {"symbols": n_symbols / max(word_chars, 1), "repeats": n_repeat / max(n_words, 1), "lines": n_dup / max(lines, 1), "long_words": length, "short_words": length, "capitals": sum("A" <= c <= "Z" for c in text) / max(word_chars, 1)}
    return max(sum(value[k] > c if op == ">" else value[k] < c for c in cuts) for k, (op, cuts) in quality.GRID.items())


def rejected(rows, marks):
    """The places of documents that the base rules or certified levels reject."""
    good = {i for i, q, _ in marks if q == 1}
    bad = {at for at, r in enumerate(rows) if (b := base(r[1]))[0] < 50 or 100 * b[4] > 50 * b[0]}
    held = defaultdict(list)
    for at, r in enumerate(rows):
        if at not in bad and r[0] in good:
            held[r[2]].append(level(r[1]))
    each = quality.DELTA / (len(held) + 1)
    tail = lambda n, k: sum(comb(n, i) * quality.ALPHA**i * (1 - quality.ALPHA) ** (n - i) for i in range(k + 1))
    group = {s: "pool" if tail(len(x), 0) > each else s for s, x in held.items()}
    cut = {}
    for g in set(group.values()):
        levels = [x for s, xs in held.items() if group[s] == g for x in xs]
        for at in range(10, 0, -1):
            k = sum(x >= at for x in levels)
            if k > len(levels) * quality.ALPHA or tail(len(levels), k) > each:
                break
            cut[g] = at
    return bad | {at for at, r in enumerate(rows) if at not in bad and r[2] in group and level(r[1]) >= cut.get(group[r[2]], 99)}


def mixed(rows):
    """How often each document comes, by a sort of hashes."""
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in sources}
    weight, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}, {}
    while free := [s for s in sources if s not in target]:
        rest, w = 1.5 * sum(total.values()) - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > 2 * total[s]]
        target |= {s: 2.0 * total[s] for s in over} or {s: rest * weight[s] / w for s in free}
    often = Counter()
    for s in sources:
        copies = int(target[s] // total[s])
        left = int(target[s]) - copies * total[s]
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16)):
            n = size(r[1])
            takes = left >= n if left >= n else 2 * left >= n > 0 and left >= 0
            often[r[0]] += copies + bool(takes)
            left = left - n if left >= n else -1
    return +often


def test_run_matches_brute_force(spark, tmp_path):
    rows, marks = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    told = lambda df: Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())
    frame = lambda rows: spark.createDataFrame(rows, docs.schema)

    gone = rejected(rows, marks)
    kept = [r for at, r in enumerate(rows) if at not in gone]
    assert told(stage["quality_rules"](spark, docs, str(tmp_path))) == Counter(kept) and any(r[0] % 10 == 0 for at, r in enumerate(rows) if at in gone and r[0] and base(r[1])[0] >= 50)

    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    found = removed([r[:2] for r in kept])
    texts = ["\n".join(x for i, x in enumerate(ls) if i not in out) for ls, out in (found[r[:2]] for r in kept)]
    deduped = [(r[0], t, r[2], r[3], len(t) if t != r[1] else r[4]) for r, t in zip(kept, texts, strict=True) if WORD.search(t)]
    assert told(stage["line_dedup"](spark, frame(kept), str(tmp_path))) == Counter(deduped) and len(deduped) < len(kept)

    fps = {r[0]: brute_fp(r[1]) for r in deduped}
    comp = roots(sorted(set(fps.values())), near)
    first = {}
    for r in deduped:
        first.setdefault(comp[fps[r[0]]], r)
    single = list(first.values())
    assert told(stage["near_dedup"](spark, frame(deduped), str(tmp_path))) == Counter(single) and len(single) < len(deduped)

    often = mixed(single)
    assert Counter(r["doc_id"] for r in stage["mixing"](spark, frame(single), str(tmp_path)).collect()) == often

    slow = Tokenizer.from_file(tokenizer_path())
    n_ids = {r[0]: len(slow.encode(r[1], add_special_tokens=False).ids) + 1 for r in single}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens, ends = Counter(), defaultdict(int)
    for r in packed:
        tokens[r["doc_id"]] += r["length"]
        ends[r["sequence_id"]] = max(ends[r["sequence_id"]], r["offset"] + r["length"])
    assert tokens == {i: n * n_ids[i] for i, n in often.items()} and sum(ends.values()) == sum(tokens.values())


@pytest.mark.parametrize("which", ["trouble", "empty"])
def test_run_on_trouble_and_empty_tables(spark, which, trouble, empty, labels, tmp_path):
    clean = spark.createDataFrame([(70, " ".join(f"clean{i}" for i in range(60)), None, None, None, "k", None, None)], trouble.schema)
    docs = trouble.unionByName(clean) if which == "trouble" else empty
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == ({70} if which == "trouble" else set())
