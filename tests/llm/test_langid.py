import numpy as np
from pyspark.sql import functions as F

from loomquery.llm import langid


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    model = langid.train(docs)
    got = langid.identify(docs, model)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
    right = got.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97
    assert got.filter("score < 0 or score > 1").count() == 0
    held = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("h")).join(got, "doc_id").filter("h <> held_out").count()
    assert held == 0


def test_edge_cases(spark, trouble, empty):
    model = langid.train(trouble)
    rows = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(trouble, model).collect()}
    assert {(2, "und"), (3, "und"), (4, "und")} <= rows and len(langid.identify(trouble, model).collect()) == 13
    none = langid.train(empty)
    assert none.langs == [] and langid.identify(empty, none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(trouble, none).collect()} == {"und"}
    single = langid.train(trouble.filter("lang = 'en'"))
    assert single.langs == ["en"] and single.predict("words")[:2] == ("en", 1.0) and single.predict("123")[0] == "und"


def test_prediction_uses_text_only(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string")})
    a, b = (sorted(tuple(r) for r in langid.identify(d, model).collect()) for d in (docs, other))
    assert a == b


def test_codes():
    for k in (2, 4, 7, 12):
        code = langid.codewords(k)
        gram = code @ code.T
        np.fill_diagonal(gram, -np.inf)
        assert code.shape[0] == k and len({tuple(r) for r in code.tolist()}) == k and gram.max() < code.shape[1]
    assert langid.codewords(4).shape[1] == 7


def test_every_language_is_learned(spark):
    """Many languages, one of them with most rows: each gets its share; of more than the sample has rows, the most frequent."""
    rows = [(f"d{i}", chr(0x4E00 + 40 * n) * 5 + " " + chr(0x4E01 + 40 * n) * 7, f"l{n:03}") for n in range(60) for i in range(8 * n, 8 * n + 8)]
    rows += [(f"h{i}", "word of the hot one", "hot") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    assert langid.train(docs, rows=61).langs == sorted({r[2] for r in rows})
    known = docs.filter(~langid.held_out("doc_id")).select("doc_id", "lang")
    of = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    for bound, each in ((30, 1), (61, 1), (61 * 4, 4), (61 * 500, 500)):
        got = {r["lang"]: r["n"] for r in langid.sample(known, bound).groupBy("lang").agg(F.count("*").alias("n")).collect()}
        asked = sorted(of, key=lambda x: (-of[x], x))[:bound]
        assert got == {x: min(each, of[x]) for x in asked}


def test_very_many_label_values_stay_bounded(spark):
    """100,000 values of lang: the driver gets as many vectors as the sample has rows, and codewords without all pairs."""
    import resource

    docs = spark.range(100_000).selectExpr("cast(id as string) as doc_id", "concat('text ', id % 7, ' of a kind ', hex(id)) as text", "concat('tag-', id) as lang")
    model = langid.train(docs.unionByName(docs.filter("doc_id < 9000").withColumn("lang", F.lit("en"))), rows=300)
    assert len(model.langs) == 300 and "en" in model.langs and model.w.shape[1] < 100
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    code = langid.codewords(40_000)
    assert code.shape[0] == 40_000 and code.shape[1] < 200 and len(np.unique(code[:2000], axis=0)) == 2000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_ties_go_to_the_first_name_and_long_texts(spark):
    same = [(f"a{i}", "very same words", lang) for i, lang in enumerate(["zz", "yy", "xx"] * 12)]
    model = langid.train(spark.createDataFrame(same, "doc_id string, text string, lang string"))
    model.weight[:], model.w[:], model.b[:] = 1 / 3, 0, 0
    assert model.langs == ["xx", "yy", "zz"] and model.predict("very same words")[0] == "xx"
    text = "very same words " * 100_000
    assert model.predict(text)[0] == "xx" and np.allclose(langid.features(text), langid.features("very same words " * 1000), atol=1e-2)


def test_repeated_rows_teach_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    once, often = (langid.train(d) for d in (docs, docs.unionByName(docs.filter("doc_id % 3 = 0"))))
    assert once.langs == often.langs and np.array_equal(once.w, often.w)


def test_features_and_decoding_match_brute_force(spark, sf):
    """The vector of a text, gram by gram, and the least weighted loss, bit by bit."""
    def vector(text):
        s = "\0" + "".join(c if c.isalpha() else "\0" for c in text.lower()) + "\0"
        s = "".join(c for i, c in enumerate(s) if i == 0 or c != "\0" or s[i - 1] != "\0")
        m, found = 2**32, np.zeros(langid.FEATURES)
        one = lambda c: ord(c) * 2654435761 % m
        two = lambda g: (one(g[0]) * 31 + ord(g[1]) * 2246822519 + 1) % m
        three = lambda g: (two(g) * 31 + ord(g[2]) * 3266489917 + 2) % m
        for n, h in ((1, one), (2, two), (3, three)):
            for i in range(len(s) - n + 1):
                x = h(s[i : i + n])
                found[((x ^ x >> 15) * 2654435761 % m) >> 20] += 1
        return np.sqrt(found) / np.sqrt(found.sum())

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    for r in docs.filter("text is not null").limit(40).collect():
        if not any(c.isalpha() for c in r["text"]):
            continue
        v = vector(r["text"])
        assert np.allclose(v, langid.features(r["text"]), atol=1e-5)
        losses = [sum(model.weight[k][j] * np.log1p(np.exp(-model.code[k][j] * (v @ model.w[:, j] + model.b[j]))) for j in range(model.code.shape[1])) for k in range(len(model.langs))]
        assert model.predict(r["text"])[0] == model.langs[int(np.argmin(losses))]
