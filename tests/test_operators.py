"""Splitters, greedy dedup, cleaning, retrieval contracts and rewriting."""

import asyncio
import json
import random
import re
import threading
import time
import unicodedata
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from loomquery.functions import text as X
from loomquery.functions import vector as V
from loomquery.operators import bm25, dedup, evaluate, fusion, ivf, knn, retriever, rewrite, segments, split, table_functions
from loomquery.plans import llm, pipeline, rag, testsets
from loomquery.plans.tables import global_scan, row_numbers, with_group_size
from loomquery.queries import QUERIES
from loomquery.sources import collections as K


def test_recursive_split():
    text = "\n\n".join(f"Paragraph {i}. " + "word " * (i * 11 % 60) for i in range(40))
    for size, overlap in ((500, 50), (200, 20), (60, 0)):
        chunks = split.split_recursively(text, size, overlap)
        assert chunks and all(c == c.strip() and c for c in chunks)
        squeezed = "".join(text.split())
        assert all("".join(c.split()) in squeezed for c in chunks)
        if overlap == 0:
            assert "".join("".join(c.split()) for c in chunks) == squeezed
    assert split.split_recursively("", 10, 0) == [] and split.split_recursively("x" * 50, 10, 0) == ["x" * 50]
    assert split.split_recursively("你好。世界！好", 3, 0) == ["你好。", "世界！", "好"]
    assert split.split_recursively("aaa\n\nbbb\n\nccc", 8, 0) == ["aaa", "bbb\nccc"]
    assert split.split_recursively("ab\ncd\nef\ngh", 7, 3) == ["ab\ncd", "cd\nef", "ef\ngh"]


def markdown_by_size(text, size):
    """A literal pass: the held lines are joined and measured before each line that isn't blank."""
    chunks, held, header = [], [], False
    for line in text.split("\n"):
        if line.strip() == "":
            held.append(line)
            continue
        header |= re.fullmatch(r"(#|##|###|####|#####|######)\s+.+", line.strip()) is not None
        if held and len("\n".join(held)) >= size * (1 + header):
            chunks.append("\n".join(held))
            held = []
        held.append(line)
    return chunks + (["\n".join(held)] if held else [])


def test_markdown_split():
    rng = random.Random(7)
    text = "# Head\n" + "\n".join("line %02d of text" % i for i in range(20))
    assert "\n".join(split.split_markdown_by_size(text, 60)) == text
    for _ in range(300):
        lines = [rng.choice(["", "  ", "# H", "####### seven", "#none", "## ", "word " * rng.randint(1, 9), "x"]) for _ in range(rng.randint(0, 40))]
        text, size = "\n".join(lines), rng.choice([1, 5, 20, 60])
        assert split.split_markdown_by_size(text, size) == markdown_by_size(text, size)


def test_parent_child(spark):
    docs = spark.createDataFrame([(1, "Sentence one here. " * 300), (2, None), (3, "short")], "doc_id long, text string")
    kids = split.parent_child(docs)
    got = split.parents(kids).collect()
    assert sum(r["child_count"] for r in got) == kids.count()
    assert kids.filter("not contains(parent_content, text)").count() == 0
    assert {r["doc_id"] for r in got} == {1, 3}


def test_semantic_thresholds(spark):
    df = spark.createDataFrame([(1, i, [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(6)], "doc_id long, pos long, embedding array<float>")
    for kind, amount in (("percentile", 95.0), ("standard_deviation", 1.0), ("absolute", 0.5)):
        assert [r["chunk"] for r in split.semantic(df, kind, amount).orderBy("pos").collect()] == [0, 0, 0, 1, 1, 1]


def test_greedy_embedding_dedup(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = [(i, [x + rng.gauss(0, 0.22) for x in centres[i % 8]]) for i in range(160)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)
    kept = []
    for i, v in rows:
        if all(cos(v, w) < 0.95 for _, w in kept):
            kept.append((i, v))
    df = spark.createDataFrame([*rows, (1000, [0.0] * 6), (1001, [0.0] * 6)], "vec_id long, embedding array<double>")
    got = sorted(r["vec_id"] for r in dedup.by_embedding(df, 0.95).collect())
    assert got == sorted([i for i, _ in kept] + [1000, 1001])
    pairs = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and cos(a[1], b[1]) >= 0.95}
    for block in (2048, 40):
        found = [(r["id_a"], r["id_b"]) for r in dedup.similar_pairs(df, 0.95, block=block).collect()]
        assert set(found) == pairs and len(found) == len(pairs)


def test_sketched_pairs_recall(spark):
    rng = random.Random(11)
    centres = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(60)]
    rows = [(i, [x + rng.gauss(0, 0.12) for x in centres[i % 60 if i % 3 else 0]]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {(r["id_a"], r["id_b"]): r["similarity"] for r in dedup.similar_pairs(df, 0.95).collect()}
    for block in (2048, 100):
        found = {(r["id_a"], r["id_b"]): r["similarity"] for r in dedup.sketched_pairs(df, 0.95, block=block).collect()}
        assert set(found) <= set(exact) and all(exact[p] == s for p, s in found.items()) and len(found) >= 0.99 * len(exact) > 1000
    kept = dedup.by_embedding(df, 0.95, pairs=dedup.sketched_pairs).count()
    assert abs(kept - dedup.by_embedding(df, 0.95).count()) <= 3


def test_header_paths(spark):
    text = "intro\n# A\n## B\n#### C\nx\n## D\n### E\n# F\n#none\nend"
    got = split.headers(spark.createDataFrame([(1, text), (2, "no header"), (3, "")], "doc_id long, text string")).orderBy("doc_id", "section").collect()
    assert [(r["doc_id"], r["header"], r["path"]) for r in got] == [
        (1, "", []), (1, "A", ["A"]), (1, "B", ["A", "B"]), (1, "C", ["A", "B", "C"]), (1, "D", ["A", "D"]), (1, "E", ["A", "D", "E"]), (1, "F", ["F"]), (2, "", []),
    ]


def test_knn_matches_numpy(spark):
    rng = random.Random(3)
    rows = [(f"v{i:03}", [rng.randint(-2, 2) * 1.0 for _ in range(4)]) for i in range(200)] + [("null", None)]
    queries = [(f"v{i:03}", rows[i][1]) for i in range(0, 200, 20)] + [("none", None)]
    df, q = spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(5), spark.createDataFrame(queries, "query_id string, query array<double>")
    far = {"cosine": lambda a, b: 1 - sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5 + 1e-8), "l2": lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5, "l1": lambda a, b: sum(abs(x - y) for x, y in zip(a, b, strict=True))}
    for metric, f in far.items():
        for alone in (False, True):
            want = {(i, r + 1): n for i, v in queries if v for r, (_, n) in enumerate(sorted((round(f(v, e), 6), n) for n, e in rows if e and not (alone and n == i))[:7])}
            assert {(r["query_id"], r["rank"]): r["vec_id"] for r in knn.search(df, q, 7, metric, exclude_self=alone).collect()} == want


def test_cleaning(spark):
    raw = "ｆｕｌｌ　ｗｉｄｔｈ ①  <b>x</b>\r\n\r\n\r\n\r\nend ​"
    df = spark.createDataFrame([(raw,), (None,), ("plain",)], "t string")
    got = [r[0] for r in df.select(X.clean("t", special=True)).collect()]
    assert got[1:] == ["", "plain"] and "<" not in got[0] and "full width 1" in got[0]
    assert df.select(X.nfkc("t")).first()[0] == unicodedata.normalize("NFKC", raw)
    quoted = spark.createDataFrame([("「甲」（乙）…",)], "t string").select(X.clean_cjk("t")).first()[0]
    assert quoted == '"甲"(乙)...'
    assert [r[0] for r in spark.createDataFrame([("a.B.PY",), ("x/y",)], "p string").select(X.extension("p")).collect()] == [".py", ""]
    custom = df.select(X.clean("t", lower=True, custom=[lambda c: F.replace(c, F.lit("plain"), F.lit("PLAIN"))]))
    assert [r[0] for r in custom.collect()][2] == "PLAIN"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(V.cosine_distance("a", "b"), V.cosine_similarity("a", "b"), V.euclidean("a", "b"), V.manhattan("a", "b"), V.score(V.cosine_distance("a", "b"), clamp=True)).collect()
    assert got[0][0] == pytest.approx(2) and got[0][1] == -1 and got[0][2] == 2 and got[0][3] == 2 and got[0][4] == 0
    assert got[1][0] == pytest.approx(1) and got[1][1] == 0
    assert V.metric_name("L1") == "manhattan" and V.metric_name("other") == "cosine"


def test_pooling_and_groups(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), (2, [[5.0, 5.0]], [0])], "id long, s array<array<float>>, m array<int>")
    assert [r[0] for r in df.orderBy("id").select(V.mean_pool("s", "m")).collect()] == [[2.0, 3.0], [0.0, 0.0]]
    groups = spark.createDataFrame([(1, ["b a", "c", None]), (2, []), (3, None), (4, ["c"])], "g long, texts array<string>")
    got = {r["g"]: r["embeddings"] for r in pipeline.encode_groups(groups, pipeline.hashing_encoder(8), "g").collect()}
    assert [len(got[i]) for i in (1, 2, 3, 4)] == [3, 0, 0, 1] and got[1][1] == got[4][0] and got[1][2] == [0.0] * 8


def test_english_sentences(spark):
    text = 'Dr. J. Smith came. "Who is it?" asked Mrs. Lee, e.g. 3. Nobody said: stop! (Why not?) Version 2.0 works. end. of it'
    got = [r["sentence"] for r in split.english_sentences(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("sentence_index").collect()]
    assert got == ["Dr. J. Smith came.", '"Who is it?" asked Mrs. Lee, e.g. 3.', "Nobody said: stop!", "(Why not?)", "Version 2.0 works. end. of it"]


def test_knn_blocks_agree(spark, sf, monkeypatch):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    whole = sorted(knn.search(e, q, 4).collect())
    alone = sorted(knn.search(e, q, 4, exclude_self=True).collect())
    monkeypatch.setattr(knn, "BLOCK", 3)
    monkeypatch.setattr(knn, "CHUNK", 40)
    many = knn.search(e, q, 4)
    assert "FlatMapCoGroupsInArrow" in many._jdf.queryExecution().executedPlan().toString() and sorted(many.collect()) == whole
    assert sorted(knn.search(e, q, 4, exclude_self=True).collect()) == alone
    assert knn.search(e, q, 1, exclude_self=True).filter("query_id = vec_id").count() == 0


def test_bm25_index_round_trip(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    q = spark.createDataFrame([(1, "the and of"), (2, ""), (3, "zzzzunknown")], "query_id long, query string")
    direct = sorted(bm25.search(docs, q, 5).collect())
    index = bm25.Index.build(docs)
    index.write(str(tmp_path / "ix"))
    read = bm25.Index.read(spark, str(tmp_path / "ix"))
    assert sorted(read.search(q, 5).collect()) == direct and {r[0] for r in direct} == {1}
    a, b = (bm25.Index.build(docs.filter(f"doc_id % 2 = {i}")) for i in (0, 1))
    assert sorted(a.add(b).search(q, 5).collect()) == direct
    assert bm25.search(docs.limit(0), q, 5).count() == 0
    chars = spark.createDataFrame([("a b",)], "t string").select(bm25.tokenize("t", "chars")).first()[0]
    assert chars == ["a", "b"]
    assert spark.createDataFrame([("The a cat",)], "t string").select(bm25.tokenize("t", "words", ["the", "a"])).first()[0] == ["cat"]


def test_fusion_contracts(spark):
    a = spark.createDataFrame([(1, 10, 1, 0.9, "x"), (1, 11, 2, 0.8, "y"), (2, 10, 1, 0.5, "x")], "query_id long, doc_id long, rank int, score double, content string")
    b = spark.createDataFrame([(1, 11, 1, 1.0, "y"), (1, 12, 2, 0.5, "x")], a.schema)
    fused = fusion.rrf({"a": a, "b": b}).filter("query_id = 1").orderBy("rank").collect()
    assert [r["doc_id"] for r in fused] == [11, 10, 12] and [r["rank"] for r in fused] == [1, 2, 3]
    assert fused[0]["score"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-8)
    unique = fusion.rrf({"a": a, "b": b}, content_col="content").filter("query_id = 1")
    assert {r["doc_id"] for r in unique.collect()} == {10, 11}
    out = {(r["query_id"], r["doc_id"]): r["score"] for r in fusion.hybrid(a, b, 5).collect()}
    assert out[2, 10] == 0.5 and out[1, 11] < 0.1
    assert fusion.normal_weights(0, 0) == (0.5, 0.5)
    with pytest.raises(ValueError):
        fusion.hybrid(None, None)
    equal = fusion.simple_rerank(a.withColumn("score", F.lit(0.4)))
    assert {r["score"] for r in equal.collect()} == {0.4}


def test_hybrid_keeps_the_order_of_a_single_leg(spark):
    """Scores that rounding made equal are not ordered anew, in the middle or at the cut."""
    leg = spark.createDataFrame([(1, 9, 1.0, 1), (1, 8, 0.63756, 2), (1, 3, 0.63756, 3), (1, 2, 0.63756, 4)], "query_id long, doc_id long, score double, rank int")
    want = [(9, 1.0, 1), (8, 0.63756, 2), (3, 0.63756, 3)]
    for found in (fusion.hybrid(None, leg, 3), fusion.hybrid(leg, None, 3), fusion.Hybrid(None, lambda queries, k: leg).search(leg, 3)):
        assert found.columns == ["query_id", "doc_id", "score", "rank"]
        assert [tuple(r)[1:] for r in found.orderBy("rank").collect()] == want
    turned = fusion.hybrid(None, leg, 1, rerank=lambda df: df.withColumn("score", -F.col("score")))
    assert [tuple(r)[1:] for r in turned.collect()] == [(2, -0.63756, 1)]


def test_rewriting_with_a_client(spark):
    class Client:
        def invoke(self, prompt):
            if "fail" in prompt:
                raise RuntimeError("no")
            return "1. one variant\n2. another variant"

    q = spark.createDataFrame([(1, "what is it?"), (2, "fail now")], "query_id long, query string")
    got = {r["query_id"]: r for r in rewrite.rewrite(q, Client).collect()}
    assert got[1]["rewritten"] == ["one variant", "another variant"] and not got[1]["fallback"]
    assert got[2]["rewritten"] == ["fail now"] and got[2]["fallback"]
    back = rewrite.rewrite(q, None, "backoff").collect()
    assert {r["query_id"]: r["rewritten"] for r in back}[2] == ["fail now"]
    names = spark.createDataFrame([("为什么这样？",), ("short text",), ("x" * 31,), ("这个怎么样或那个",)], "q string")
    assert [r[0] for r in names.select(rewrite.strategy(F.col("q"))).collect()] == ["expansion", "expansion", "specific", "decomposition"]


def test_rag_answers_every_query(spark):
    q = spark.createDataFrame([(1, "where is the cat?"), (2, "nothing found?")], "query_id long, query string")
    r = spark.createDataFrame([(1, 1, 0.9, "a.txt", "The cat is here. Dogs bark."), (1, 2, 0.2, "b.txt", "Low score.")], "query_id long, rank int, score double, source string, content string")
    got = {x["query_id"]: x for x in rag.answer(q, r).collect()}
    assert got[1]["sources"] == ["a.txt"] and got[1]["num_retrieved"] == 1 and "cat" in got[1]["answer"]
    assert got[2]["num_retrieved"] == 0 and got[2]["answer"]
    assert "".join(rag.stream("cat?", "The cat sat. Dogs.")) and isinstance(llm.create(), llm.Extractive)
    with pytest.raises(ValueError):
        llm.create("none")


def test_row_numbers(spark):
    got = row_numbers(spark.range(500).select((F.col("id") * 37 % 501).alias("x")), F.col("x")).orderBy("x").collect()
    assert [r["rn"] for r in got] == list(range(1, 501))


def test_global_scan_and_group_sizes(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("k"))
    cum = 0
    for i, r in enumerate(global_scan(df.select("x"), [F.col("x")], {"cum": "x"}).orderBy("x").collect(), 1):
        cum += r["x"]
        assert r["rn"] == i and r["cum"] == cum
    got = {(r["k"], r["n"]) for r in with_group_size(df, "k", "n").collect()}
    assert got == {(r["k"], r["count"]) for r in df.groupBy("k").count().collect()}


def test_hybrid_search_of_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("doc_id < 60")
    embed = pipeline.hashing_encoder(32)
    vectors = docs.select("doc_id", embed("text").alias("embedding"))
    queries = docs.filter("doc_id in (3, 4)").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 200).alias("query"))
    h = fusion.Hybrid(fusion.semantic_leg(vectors, embed), fusion.keyword_leg(docs))
    found = {(r["query_id"], r["rank"]): r["doc_id"] for r in h.search(queries, 3).collect()}
    assert len(found) == 6 and 3 in (found[3, 1], found[3, 2]) and found[4, 1] == 4
    h.set_weights(1, 3)
    h.reranker = lambda df: df.withColumn("score", -F.col("score"))
    assert h.weights == (0.25, 0.75) and h.stats()["rerank"]
    turned = h.search(queries, 6).collect()
    h.rerank = False
    assert not h.stats()["rerank"] and {r["doc_id"] for r in h.search(queries, 6).collect()} and turned
    lone = fusion.Hybrid(None, fusion.keyword_leg(docs)).search(queries, 2)
    assert lone.count() == 4 and fusion.over_fetch(3) == 10 and fusion.over_fetch(9) == 18


def test_cross_encoder(spark):
    pairs = spark.createDataFrame([(1, 10, "cat", "cat cat"), (1, 11, "cat", "dog"), (1, 12, "cat", None), (2, 10, "dog", "dog")], "query_id long, doc_id long, query string, content string")

    def one_logit():
        return lambda q, t: [[float(b.split().count(a))] for a, b in zip(q, t, strict=True)]

    def two_logits():
        return lambda q, t: [[0.0, float(b.split().count(a))] for a, b in zip(q, t, strict=True)]

    for load in (one_logit, two_logits):
        got = {(r["query_id"], r["doc_id"]): (r["score"], r["rank"]) for r in fusion.rerank(pairs, fusion.cross_encoder(load, batch=2)).collect()}
        assert got[1, 10] == (round(1 / (1 + 2.718281828459045**-2), 6), 1) and got[1, 11] == (0.5, 2) and got[1, 12] == (0.5, 3) and got[2, 10][1] == 1
    some = fusion.as_results(spark.createDataFrame([(5, "a", 0.2), (6, "b", 0.7)], "doc_id long, text string, score double"))
    assert [(r["doc_id"], r["content"], r["rank"], r["source"]) for r in some.orderBy("rank").collect()] == [(6, "b", 1, None), (5, "a", 2, None)]


def test_rewrite_cache_timeout_and_strategies(spark):
    class Slow:
        def invoke(self, prompt):
            time.sleep(2 if "slow" in prompt else 0)
            return "a reply of " + prompt.split()[1]

    q = spark.createDataFrame([(1, "slow one"), (2, "quick one")], "query_id long, query string")
    got = {r["query_id"]: r for r in rewrite.rewrite(q, Slow, "expansion", timeout=0.5).collect()}
    assert got[1]["fallback"] and got[1]["rewritten"] == ["slow one"] and got[2]["rewritten"] == ["a reply of three"]
    cache = spark.createDataFrame([(7, "slow one", "expansion", ["held"], False), (8, "quick one", "expansion", ["quick one"], True)], "query_id long, query string, strategy string, rewritten array<string>, fallback boolean")
    again = {r["query_id"]: r for r in rewrite.rewrite(q, Slow, "expansion", timeout=0.5, cache=cache).collect()}
    assert again[1]["rewritten"] == ["held"] and not again[1]["fallback"] and again[2]["rewritten"] == ["a reply of three"]
    every = rewrite.multi_strategy(q.filter("query_id = 2"), Slow)
    assert {r["strategy"] for r in every.collect()} == set(rewrite.STRATEGIES)
    assert {r["variant"] for r in rewrite.variants(every).collect()} == {"quick one", "a reply of three", "a reply of this", "a reply of a"}


class Service(BaseHTTPRequestHandler):
    """Chat completions, whole or as events, and embeddings; the first request fails."""

    failed = False

    def log_message(self, *_):
        pass

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if not Service.failed:
            Service.failed = True
            return self.send_error(503)
        if self.path.endswith("embeddings"):
            reply = json.dumps({"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]})
        elif body.get("stream"):
            pieces = [{"choices": [{"delta": {"content": x}}]} for x in ("one ", "two")] + [{"choices": [{"delta": {}}]}]
            reply = "".join(f"data: {json.dumps(p)}\n\n" for p in pieces) + ": note\n\ndata: [DONE]\n\n"
        else:
            reply = json.dumps({"model": "m", "usage": {"total_tokens": 3}, "choices": [{"message": {"content": "said " + body["messages"][0]["content"]}, "finish_reason": "stop"}]})
        self.send_response(200)
        self.end_headers()
        self.wfile.write(reply.encode())


def test_clients(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        client = llm.create("http", url=url, model="m")
        assert client.invoke("hello") == "said hello" and client.respond("x").usage == {"total_tokens": 3}
        assert list(client.stream("x")) == ["one ", "two"]

        async def gather():
            return [x async for x in client.astream("x")], await client.abatch(["a", "b"])

        assert asyncio.run(gather()) == (["one ", "two"], ["said a", "said b"]) and client.batch(["c"]) == ["said c"]
        encode = pipeline.EMBEDDERS["remote"](url, "m", batch=2)
        rows = spark.createDataFrame([("a",), ("bbb",), (None,), ("cc",), ("dddd",)], "t string").coalesce(1)
        assert [r[0] for r in rows.select(encode("t")).collect()] == [[float(n), 1.0] for n in (1, 3, 0, 2, 4)]
    finally:
        server.shutdown()
    assert llm.Extractive().n_tokens("汉字 abcd") == int(3 + 0.25 * 5)
    model = pipeline.encoder(lambda: lambda texts: [[float(len(t))] for t in texts], batch=2, instruction="q: ", most=1)
    assert [r[0] for r in rows.select(model("t")).collect()] == [[4.0], [6.0], [3.0], [5.0], [7.0]]
    pipeline.register_embedder("mine", lambda: model)
    assert pipeline.EMBEDDERS["mine"]() is model


def test_testsets_and_chain(spark):
    facts = ["The cat sleeps on the warm windowsill.", "Dogs bark at passing cars every morning.", "Rivers carry sediment toward the distant ocean.", "Bread rises because yeast makes carbon dioxide."]
    chunks = spark.createDataFrame([(i, f) for i, f in enumerate(facts)], "doc_id long, text string")
    samples = testsets.from_documents(chunks, pairs=4)
    got = samples.orderBy("ground_truth_context").collect()
    assert len(got) == 4 and all(r["answer"] == r["ground_truth_context"] and "____" in r["question"] for r in got)
    assert testsets.from_documents(chunks, pairs=2).count() == 2
    assert testsets.from_contexts(spark.createDataFrame([(0, ""), (1, "One sentence here.")], "bucket long, context string"), pairs=1).count() == 1
    assert "## Known answer\ntruth" in spark.createDataFrame([("c", "truth")], "c string, t string").select(testsets.generation_prompt(F.col("c"), F.col("t"), ["factual"])).first()[0]
    content = chunks.select("doc_id", F.col("text").alias("content"), F.concat(F.lit("s"), "doc_id").alias("source"))
    leg = fusion.keyword_leg(chunks)
    chain = rag.Chain(lambda q, k: leg(q, k).join(content, "doc_id"), k=2, threshold=0.1)
    done = testsets.evaluate_documents(chunks, chain, pairs=4, metrics=["faithfulness", "context_recall", "hit_rate"])
    means = {m["metric_name"]: m["mean"] for m in done["metrics"]}
    assert done["scores"].count() == 4 and means["hit_rate"] == 1.0 and means["context_recall"] > 0.9 and done["seconds"] > 0
    assert "The cat sleeps" in "".join(chain.stream(spark, "What sleeps on the windowsill?"))
    assert asyncio.run(chain.ainvoke(spark.createDataFrame([(1, "Who barks?")], "query_id long, query string"))).count() == 1


def test_buckets_match_a_sequential_pass(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    from loomquery.operators.evaluate import testset_buckets

    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    for pairs, most in ((3, 100), (7, 8000), (500, 50)):
        size = max(1, len(rows) // pairs)
        want = {b: ("\n".join(x for _, x in rows[b * size : (b + 1) * size])[:most], len(rows[b * size : (b + 1) * size])) for b in range(min(pairs, -(-len(rows) // size)))}
        assert {r["bucket"]: (r["context"], r["n_chunks"]) for r in testset_buckets(docs, pairs, most).collect()} == want


def test_queries_without_sql(spark, sf):
    """Against plain Python over every document."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}

    def squeezed(t):
        t = re.sub("<[^>]+>", " ", unicodedata.normalize("NFKC", t or ""))
        for a, b in zip("「」『』“”‘’（）【】《》", "\"\"''\"\"''()[]<>", strict=True):
            t = t.replace(a, b)
        t = "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) < 0xFF5F else c for c in t.replace("\u3000", " ")).replace("——", "--").replace("…", "...")
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t.replace("\r\n", "\n"))).strip(" \t\n\x0b\f\r")

    assert {r["doc_id"]: r["text"] for r in QUERIES["clean_full"](spark, sf).collect()} == {i: squeezed(t) for i, t in texts.items()}
    chunks = lambda name: sorted((r["doc_id"], r["chunk_index"], r["total_chunks"], r["text"]) for r in QUERIES[name](spark, sf).collect())
    every = lambda f: sorted((i, n, len(c), x) for i, t in texts.items() for c in [f(t) if t else []] for n, x in enumerate(c))
    assert chunks("split_markdown") == every(lambda t: markdown_by_size(t, 500))
    assert chunks("split_recursive") == every(split.split_recursively)
    assert all(len(x) <= 600 or not re.search(r"[,.;!?\n]\s", x) for _, _, _, x in chunks("split_recursive"))
    kids = sorted((r["doc_id"], r["parent_index"], r["child_index"], r["text"]) for r in QUERIES["split_parent_child"](spark, sf).collect())
    want = [(i, p, c, x) for i, t in texts.items() if t for p, parent in enumerate(split.split_recursively(t, 1500, 150)) for c, x in enumerate(split.split_recursively(parent, 200, 20))]
    assert kids == sorted(want)
    found = {(r["doc_id"], r["parent_index"]): r["child_count"] for r in QUERIES["parent_recovery"](spark, sf).collect()}
    assert found == {k: sum(x[:2] == k for x in want) for k in {x[:2] for x in want}}
    answers = QUERIES["rag_answer"](spark, sf).collect()
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert {r["query_id"]: r["question"] for r in answers} == items
    top = {}
    for r in bm25.search(spark.read.parquet(f"{sf}/documents.parquet"), spark.createDataFrame(list(items.items()), "query_id long, query string"), 5).collect():
        top.setdefault(r["query_id"], []).append((r["rank"], r["score"]))
    for r in answers:
        scores = [s for _, s in sorted(top.get(r["query_id"], [])) if s >= 0.5]
        assert r["retrieval_scores"] == scores and r["num_retrieved"] == len(scores) and r["answer"]


def test_vector_index(spark, sf, tmp_path, monkeypatch):
    """Recall against the exact search, every row in one list, the exact way, and the partitions that are read."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    hot = e.filter("vec_id = 3").withColumn("vec_id", F.explode(F.sequence(F.lit(10_000), F.lit(10_299))))
    rows = e.unionByName(hot).unionByName(spark.createDataFrame([(99_999, None)], e.schema))
    monkeypatch.setattr(ivf, "CHUNK", 64)
    index = ivf.VectorIndex.build(rows, str(tmp_path / "ix"), lists=16)
    assert index.about["rows"] == 800 and len(index.centroids) == 16 and 1 <= index.probes < 16
    assert sorted(r["id"] for r in index.rows().collect()) == sorted(r["vec_id"] for r in rows.filter("embedding is not null").collect())
    sizes = {r["list"]: (r["n"], r["parts"]) for r in index.rows().groupBy("list").agg(F.count("*").alias("n"), F.countDistinct("part").alias("parts")).collect()}
    assert sum(n for n, _ in sizes.values()) == 800 and max(n for n, _ in sizes.values()) >= 300 and max(p for _, p in sizes.values()) >= 5
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = sorted(tuple(r) for r in knn.search(rows, q, 10).collect())
    assert sorted(tuple(r) for r in index.search(q, 10, probes=16).collect()) == exact
    found = {(r[0], r[1]) for r in index.search(q, 10).collect()}
    assert len(found & {(r[0], r[1]) for r in exact}) >= 0.9 * len(exact) and index.recall(q) >= 0.9
    for metric in ("l2", "l1"):
        other = ivf.VectorIndex.build(e, str(tmp_path / metric), metric=metric, lists=8)
        assert sorted(tuple(r) for r in other.search(q.limit(20), 5, probes=8).collect()) == sorted(tuple(r) for r in knn.search(e, q.limit(20), 5, metric).collect())
    one = index.search(q.filter("query_id = 7"), 10, probes=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    wanted = re.search(r"PartitionFilters: \[[^\]]*?list#\d+ IN \(([\d,]+)\)", plan)
    assert wanted, re.findall("PartitionFilters: .{0,200}", plan)
    assert len(wanted[1].split(",")) == 2
    none = ivf.VectorIndex.build(e.limit(0), str(tmp_path / "none"))
    assert none.rows().count() == 0 and none.search(q).count() == 0
    few = ivf.VectorIndex.build(e.limit(1), str(tmp_path / "few"))
    assert few.search(q, 3).count() == q.count()


def test_approximate_search_of_a_collection(spark, sf, tmp_path):
    """What was added, replaced and taken away after the index was built."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    records = e.select(F.col("vec_id").cast("string").alias("id"), F.lit("x").alias("document"), "embedding")
    c = K.Collection(spark, str(tmp_path), "c")
    c.add(records.filter("id < 400"))
    q = e.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert sorted(c.search(q, 5, approximate=True).collect()) == sorted(c.search(q, 5).collect())
    index = c.build_index(lists=8)
    c.add(records.filter("id >= 400"))
    c.delete(ids=["0", "50"])
    c.upsert(records.filter("id = 75").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    assert sorted(c.search(q, 5, approximate=True, probes=8).collect()) == sorted(c.search(q, 5).collect())
    about = c.search(q, 5, approximate=True).join(c.search(q, 5).select("query_id", "id"), ["query_id", "id"]).count()
    assert about >= 0.85 * 5 * q.count() and index.about["rows"] == 400
    c.compact()
    assert c._indexed() is None and sorted(c.search(q, 5, approximate=True).collect()) == sorted(c.search(q, 5).collect())


def _same(a, b):
    return sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect())


def test_segments_equal_a_fresh_build(spark, tmp_path, monkeypatch):
    """Additions, replacements, deletions and merges, with small shards, blocks and groups, against the search without an index."""
    for name, value in (("SHARD", 25), ("QUERIES", 7), ("NAMED", 30)):
        monkeypatch.setattr(segments, name, value)
    monkeypatch.setattr(segments, "_BLOCKS", segments._BLOCKS.replace(str(segments.BLOCK), "4"))
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(80)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(80)], k=n))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    state = {i: text(rng.choice([0, 1, 5, 40, 200])) for i in range(200)} | {i: "tie tie w1" for i in range(200, 230)} | {300: None, 301: " ", 302: "w0 " * 3000}
    queries = spark.createDataFrame([(i, text(rng.randint(1, 25))) for i in range(30)] + [(90, "tie"), (91, "unknown"), (92, ""), (93, "w0 w0 w0 w70")], "query_id long, query string")
    index = segments.SegmentedIndex(spark, str(tmp_path / "ix"))
    assert index.search(queries).count() == 0 and index.lexicon().count() == 0 and index.totals() == (0, 0) and index.delete(frame([(1, "")])) == 0

    def agrees(kinds=("ratio",)):
        docs = frame(list(state.items()))
        fresh = bm25.Index.build(docs)
        assert _same(index.lexicon(), fresh.lexicon) and index.totals() == (fresh.n, fresh.avgdl)
        for kind in kinds:
            found, read = index.search_counted(queries, 7, kind)
            assert _same(found, bm25.search(docs, queries, 7, idf_kind=kind))
            assert read.filter("blocks_read > blocks or blocks_read < 1").count() == 0
        assert _same(index.search(queries, 9, threshold=0.4), bm25.search(docs, queries, 9, threshold=0.4))

    everything = dict(state)
    for part in range(3):
        index.add(frame([(i, t) for i, t in everything.items() if i % 3 == part]))
    agrees(("ratio", "okapi"))
    gone = [i for i in state if i % 7 == 0]
    assert index.delete(frame([(i, None) for i in [*gone, 5555]])) == len(gone)
    state = {i: t for i, t in state.items() if i % 7}
    agrees()
    changed = {i: text(30) for i in (1, 2, 14, 200)}
    assert index.add(frame([*changed.items(), *changed.items()])) == 4
    state |= changed
    agrees()
    assert index.merge(below=78) == 2 and len(index.about()["segments"]) == 3 and index.about()["gone"]
    agrees()
    assert index.merge() == 3 and not index.about()["gone"] and len(index.about()["segments"]) == 1 and index.merge() == 0
    agrees(("okapi",))
    assert segments.SegmentedIndex(spark, str(tmp_path / "ix")).totals()[0] == len(state) and index.terms().count() == index.lexicon().count()
    assert index.clear() and not index.about()["segments"]


def test_segments_move_texts_once(spark, tmp_path, monkeypatch):
    """Neither an addition nor a merge writes or shuffles anything of the size of texts or postings twice; repeated ids, dead shards and shards that meet."""
    monkeypatch.setattr(segments, "SHARD", 10)
    monkeypatch.setattr(segments, "SPAN", 2)
    written, save = [], segments.save
    monkeypatch.setattr(segments, "save", lambda df, name="table", **rest: written.append(df.dtypes) or save(df, name, **rest))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index, state = segments.SegmentedIndex(spark, str(tmp_path / "ix")), {}
    for part in range(4):
        new = {i: f"w{i % 9} w{i % 4} both" for i in range(part * 20, part * 20 + 27)}
        assert index.add(frame([*new.items(), (part * 20, "zz later"), (part * 20 + 1, None), (part * 20 + 1, "zz")])) == 27
        state |= new | {part * 20 + 1: None}
    assert index.delete(frame([(i, "") for i in range(30, 70)])) == 40
    state = {i: t for i, t in state.items() if not 30 <= i < 70}

    def agrees():
        docs, queries = frame(list(state.items())), frame([(1, "w3 both"), (2, "w0 w8 zz")]).toDF("query_id", "query")
        assert _same(index.lexicon(), bm25.Index.build(docs).lexicon) and _same(index.search(queries, 6, "okapi"), bm25.search(docs, queries, 6, idf_kind="okapi"))

    agrees()
    assert index.merge() == 4 and not index.about()["gone"]
    agrees()
    shards = index._read("docs").groupBy("shard").agg(F.count("*").alias("n"), F.max("ord").alias("last")).collect()
    assert all(r["n"] == r["last"] + 1 for r in shards) and len(shards) < len(state)
    assert index.delete(frame([(i, "") for i in state])) == len(state) and index.merge() == 1 and index.totals()[0] == 0 and index.lexicon().count() == 0
    moves = [d for d in written if {"text", "tokens", "counts", "ps"} & {c for c, _ in d}]
    assert written and not moves


def test_less_than_half_of_the_blocks_are_read(spark, sf, tmp_path):
    """At sf0.1, for whole benchmark texts; and only the files' parts that hold the queries' tokens."""
    where = sf.replace("0.001", "0.1")
    queries = spark.read.parquet(f"{where}/benchmark.parquet").selectExpr("item_id query_id", "text query").filter("query_id < 60")
    index = segments.SegmentedIndex(spark, str(tmp_path / "ix"))
    index.add(spark.read.parquet(f"{where}/documents.parquet"))
    found, read = index.search_counted(queries, 10)
    total = read.agg(F.sum("blocks").alias("all"), F.sum("blocks_read").alias("read")).first()
    assert total["read"] < total["all"] / 2 and found.count() == 600
    few = index._read("blocks").filter(F.col("token").isin(["the", "and"]))
    assert "PushedFilters: [In(token" in few._jdf.queryExecution().executedPlan().toString() or "In(token, [and,the])" in few._jdf.queryExecution().executedPlan().toString()


def test_greedy_dedup_by_components(spark, monkeypatch):
    """A chain of 5,000 in a few jobs; large and small components, whichever way they are settled, against a plain loop."""
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(5000)] + [(10_000 + min(a, b), 10_000 + max(a, b)) for a, b in ((rng.randrange(400), rng.randrange(400)) for _ in range(300)) if a != b]
    ids = sorted({x for p in links for x in p} | {99_999})
    near = {}
    for a, b in links:
        near.setdefault(b, set()).add(a)
    kept = set()
    for i in ids:
        if not near.get(i, set()) & kept:
            kept.add(i)
    vectors = spark.createDataFrame([(i,) for i in ids], "vec_id long")
    found = lambda *_: spark.createDataFrame(links, "id_a long, id_b long")
    spark.sparkContext.setJobGroup("chain", "chain")
    got = {r["vec_id"] for r in dedup.by_embedding(vectors, pairs=found).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    spark.sparkContext.setJobGroup("", "")
    assert got == kept and 0 < len(jobs) < 10
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links[5000:] + links[:60]:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    some = spark.createDataFrame([(a, b) for a, b in links[5000:] + links[:60]], "early long, id long")
    assert {r["id"]: r["root"] for r in dedup.components(some).collect()} == {i: root(i) for p in links[5000:] + links[:60] for i in p}
    # small bounds: components one by one, the largest by rounds
    monkeypatch.setattr(dedup, "SETTLED", 20)
    small = lambda *_: some.withColumnsRenamed({"early": "id_a", "id": "id_b"})
    picked = [i for i in ids if i <= 60 or i >= 10_000]
    assert {r["vec_id"] for r in dedup.by_embedding(vectors.filter("vec_id <= 60 or vec_id >= 10000"), pairs=small).collect()} == kept & set(picked)


def test_splitters_as_table_functions(spark, sf):
    table_functions.register(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "  ")], docs.schema)).createOrReplaceTempView("some_documents")
    made = lambda call: spark.sql(f"select d.doc_id, c.* from some_documents d, lateral {call} c")
    want = split.recursive(docs, 300, 30).select("doc_id", "chunk_index", "total_chunks", "text")
    assert _same(made("split_text(d.text, 'recursive', 300, 30)"), want) and want.count() > 200
    assert _same(made("split_text(d.text)"), split.recursive(docs).select("doc_id", "chunk_index", "total_chunks", "text"))
    assert _same(made("split_text(text => d.text, kind => 'markdown', size => 400)").filter("doc_id >= 0"), split.markdown(docs, 400).select("doc_id", "chunk_index", "total_chunks", "text"))
    family = made("split_text(d.text, 'parent_child', 1500, 150)")
    assert family.columns == ["doc_id", "parent_index", "parent_content", "chunk_index", "total_chunks", "text"]
    own = split.parent_child(docs, (1500, 150), (300, 30)).select("doc_id", "parent_index", "parent_content", "child_index", "text")
    assert _same(family.drop("total_chunks"), own)
    for call in ("split_text(d.text, 'other')", "split_text(d.text, 'recursive', 0)", "split_text(d.doc_id)", "split_text(d.text, 'recursive', cast(d.doc_id as int))"):
        with pytest.raises(Exception, match="(?i)splitter|positive|string|constant"):
            made(call).collect()


def test_quantile_sketches_merge(spark):
    """Stored by run and merged, against exact ranks; a sketch of a few scores is exact."""
    rng = random.Random(2)
    rows = [(run, m, round(rng.random() ** 2, 4)) for run in range(5) for m in ("a", "b") for _ in range(4000 * (run + 1))] + [(0, "few", x / 10) for x in range(10)] + [(1, "few", None)]
    df = spark.createDataFrame(rows, "run int, metric_name string, score double")
    stored = evaluate.sketches(df, ("run", "metric_name"))
    at = (0.01, 0.25, 0.5, 0.75, 0.9)
    for r in evaluate.quantiles(evaluate.merged(stored), at).collect():
        own = sorted(x[2] for x in rows if x[1] == r["metric_name"] and x[2] is not None)
        assert r["n"] == len(own)
        for q in at:
            v = r[f"p{round(100 * q):02d}"]
            low, high = sum(x < v for x in own) / len(own), sum(x <= v for x in own) / len(own)
            assert low - 0.015 <= q <= high + 0.015 or len(own) == 10 and v in own
    assert stored.count() == 11 and evaluate.quantiles(stored).columns == ["run", "metric_name", "n", "p25", "p50", "p75"]
    one = evaluate.distribution(df.filter("score is not null")).select("metric_name", "p50").collect()
    assert all(abs(r["p50"] - {s["metric_name"]: s["p50"] for s in evaluate.quantiles(evaluate.merged(stored)).collect()}[r["metric_name"]]) < 0.12 for r in one)


def test_metrics_cut_once_equal_each_alone(spark):
    from loomquery.functions import metrics

    rows = [("q a b", "a b. c d! e", "a z", ["a b c", "q"]), ("", "", "", []), (None, "a", "b", ["x"]), ("q", None, "g", None), ("q q r", "R. q", "r s t", ["r s", "", "q r t"]), ("a", "b", None, ["a", None])]
    df = spark.createDataFrame(rows, "question string, answer string, ground_truth string, contexts array<string>")
    metrics.register("own", lambda q, a: F.length(q) + F.length(a), ("question", "answer"))
    try:
        names = list(metrics.REGISTRY)
        got = evaluate.evaluate(df)
        assert got.columns == [*df.columns, *names] and "own" in names
        assert got.collect() == df.withColumns({m: F.round(metrics.metric(m), 6) for m in names}).collect()
    finally:
        del metrics.REGISTRY["own"]


def test_retrievers_tell_what_happened(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("doc_id < 120")
    queries = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id query_id", "text query").filter("query_id < 6")
    word = retriever.Keyword(segments.SegmentedIndex(spark, str(tmp_path / "seg")), docs.limit(0))
    near = retriever.Semantic(K.Collection(spark, str(tmp_path), "col", embed=pipeline.hashing_encoder(32)))
    both = retriever.Fused([word, near], k=4)
    assert both.add(docs.filter("doc_id < 60")) == 60 and both.add(docs.filter("doc_id >= 60")) == 60
    near.collection.build_index(lists=4)
    for one in (word, near, both):
        got = one.retrieve(queries)
        assert not got.failed and got.notes["retriever"] == one.name and got.notes["results"] == got.results.count() > 0 and got.notes["seconds"] >= 0
        assert got.results.columns == ["query_id", "doc_id", "content", "score", "rank"]
        assert got.results.groupBy("query_id").agg(F.max("rank").alias("r")).filter(F.col("r") > one.k).count() == 0
        texts = {str(r["doc_id"]): r["text"] for r in docs.collect()}
        assert all(texts[r["doc_id"]] == r["content"] for r in got.results.collect())
    assert {x["retriever"] for x in both.retrieve(queries).notes["legs"]} == {"keyword", "semantic"} and near.stats()["indexed"] and word.stats()["segments"] == 2
    want = bm25.search(docs, queries, 5, idf_kind="okapi").select("query_id", F.col("doc_id").cast("string").alias("doc_id"), "rank")
    assert _same(word.retrieve(queries).results.select("query_id", "doc_id", "rank").filter("rank = 1"), want.filter("rank = 1"))
    # a failing leg is noted, the other one goes on; a threshold and a filter are too
    filtered = both.retrieve(queries, filters={"source": "nowhere"})
    assert not filtered.failed and "no metadata" in filtered.notes["legs"][0]["error"] and filtered.results.count() == 0
    alone = word.retrieve(queries, filters={"source": "x"})
    assert alone.failed and alone.results.count() == 0 and alone.notes["results"] == 0
    assert "lack" in near.retrieve(queries.drop("query_id")).error and retriever.Retriever(spark).retrieve(queries).failed
    assert near.retrieve(queries, threshold=2.0).results.count() == 0
    gone = docs.filter("doc_id < 30").select("doc_id")
    assert both.delete(gone) == 30 and word.stats()["documents"] == 90 == near.stats()["documents"]
    assert not {r["doc_id"] for r in both.retrieve(queries, 50).results.collect()} & {str(i) for i in range(30)}


def test_segmenter(spark):
    kind = bm25.segmenter(["中文", "分词", "中文分词", "知识库"])
    rows = [("中文分词 in Apache Spark4 的知识库。", ["中文分词", "in", "Apache", "Spark4", "的", "知识库"]), ("", []), (None, []), ("中文词 a-B", ["中文", "词", "a", "B"])]
    df = spark.createDataFrame(rows, "text string, want array<string>")
    assert df.withColumn("got", bm25.tokenize("text", kind)).filter("got <> want").count() == 0
    found = bm25.search(df.withColumn("doc_id", F.monotonically_increasing_id()), spark.createDataFrame([(1, "知识库 Apache")], "query_id long, query string"), tokenizer=kind, idf_kind="okapi")
    assert found.count() == 1


def test_slow_calls_hold_few_threads():
    slots, running, most = llm.Slots(2), [0], [0]

    def slow():
        running[0] += 1
        most[0] = max(most[0], running[0])
        time.sleep(0.6)
        running[0] -= 1
        return "late"

    began = time.monotonic()
    assert [slots.within(slow, 0.1) for _ in range(5)] == [None] * 5 and most[0] <= 2 and time.monotonic() - began < 2
    time.sleep(0.8)
    assert slots.within(lambda: "soon", 1.0) == "soon" and slots.within(lambda: 1 / 0, 1.0) is None and slots.within(lambda: "now", None) == "now" and slots.within(lambda: 1 / 0, None) is None
