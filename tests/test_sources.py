"""Loaders, collections, reports, pipelines and streaming on temporary files."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomquery.operators import evaluate
from loomquery.plans import config, pipeline, report
from loomquery.sources import collections as K
from loomquery.sources import datasource
from loomquery.sources import loaders, sinks
from loomquery.streaming import ingest


def _zip(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return b.getvalue()


W = 'xmlns:w="urn:w"'
DOCX = _zip({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>First </w:t></w:r><w:r><w:t>para</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
A = 'xmlns:a="urn:a" xmlns:p="urn:p"'
SLIDE = f'<p:sld {A}><p:cSld><p:spTree><p:sp><a:off x="1" y="9"/><a:p><a:r><a:t>low</a:t></a:r></a:p></p:sp><p:sp><a:off x="1" y="2"/><a:p><a:r><a:t>high</a:t></a:r></a:p></p:sp></p:spTree></p:cSld></p:sld>'


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: Own\ntags: x\n---\n# Head\nbody\n")
    (tmp_path / "b.md").write_text("no front\n# The Title\nbody")
    (tmp_path / "c.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "d.csv").write_text('name,note,kind\nann,"two\nlines",k\n,,\nbob,,z\n')
    (tmp_path / "e.docx").write_bytes(DOCX)
    (tmp_path / "f.pptx").write_bytes(_zip({"ppt/slides/slide2.xml": SLIDE, "ppt/slides/slide1.xml": SLIDE.replace("high", "first")}))
    (tmp_path / "g.docx").write_bytes(b"broken")
    (tmp_path / "h.unknown").write_text("?")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "i.txt").write_text("deep")
    return tmp_path


def test_loaders(spark, folder):
    md = {r["file_name"]: r for r in loaders.markdown(spark, f"{folder}/*.md").collect()}
    assert md["a.md"]["metadata"]["title"] == "Own" and md["a.md"]["metadata"]["tags"] == "x" and md["a.md"]["text"].startswith("# Head")
    assert md["b.md"]["metadata"]["title"] == "The Title"
    code = loaders.load(spark, f"{folder}/c.py").first()
    assert code["metadata"] == {"language": "python", "line_count": "3"}
    rows = loaders.csv(spark, f"{folder}/d.csv", metadata_columns=["kind"]).orderBy("text").collect()
    assert [r["text"] for r in rows] == ["name: ann\nnote: two\nlines\nkind: k", "name: bob\nkind: z"] and [r["metadata"]["row"] for r in rows] == ["0", "2"]
    named = loaders.csv(spark, f"{folder}/d.csv", ["note"], source_column="name").collect()
    assert [(r["source"], r["text"]) for r in named] == [("ann", "note: two\nlines")]
    docx = {r["file_name"]: r for r in loaders.docx(spark, f"{folder}/*.docx").collect()}
    assert docx["e.docx"]["text"] == "First para\n\na | b" and docx["e.docx"]["metadata"]["tables"] == "1"
    assert docx["g.docx"]["text"] == "" and "error" in docx["g.docx"]["metadata"]
    assert loaders.pptx(spark, f"{folder}/f.pptx").first()["text"] == "[Slide 1]\nfirst\nlow\n\n[Slide 2]\nhigh\nlow"
    pdf = loaders.binary(spark, f"{folder}/c.py", loaders.pages_parser(lambda b: ["p1", "p2"]), "pdf").first()
    assert pdf["text"] == "[Page 1]\np1\n\n[Page 2]\np2" and pdf["metadata"] == {"total_pages": "2"}
    image = loaders.binary(spark, f"{folder}/c.py", loaders.image_parser(lambda b: []), "image").first()
    assert image["metadata"]["ocr_detected"] == "false"
    with pytest.raises(ValueError):
        loaders.load(spark, f"{folder}/h.unknown")
    with pytest.raises(ValueError):
        loaders.required_csv(spark, f"{folder}/d.csv", [])
    assert loaders.directory(spark, str(folder), [".md", ".txt"]).count() == 3
    assert loaders.directory(spark, str(folder), [".md", ".txt"], recursive=False).count() == 2
    assert loaders.load_all(spark, [f"{folder}/a.md", f"{folder}/b.md", f"{folder}/c.py"]).count() == 3
    assert loaders.files(spark, str(folder), [".py"]).count() == 1
    assert len(loaders.file_hash(spark, f"{folder}/c.py").first()["hash"]) == 32
    assert loaders.files(spark, f"{folder}/nowhere").count() == 0
    missed = []
    assert loaders.load_all(spark, [f"{folder}/a.md", f"{folder}/gone.md", f"{folder}/h.unknown"], lambda p, e: missed.append(p)).count() == 1 and len(missed) == 2


def test_pdf_and_images(spark, folder):
    (folder / "p.pdf").write_bytes(b"one|two")
    (folder / "q.png").write_bytes(b"line")
    got = loaders.pdf(spark, f"{folder}/p.pdf", lambda b: b.decode().split("|")).first()
    assert got["text"] == "[Page 1]\none\n\n[Page 2]\ntwo" and got["file_type"] == "pdf"
    assert loaders.image(spark, f"{folder}/q.png", lambda b: [b.decode()]).first()["metadata"] == {"ocr_detected": "true", "detected_lines": "1"}
    for name in ("p.pdf", "q.png"):  # broken files, or no library: an empty document that says so
        row = loaders.load(spark, f"{folder}/{name}").first()
        assert row["text"] == "" and row["metadata"]["error"]


def test_suffixes_of_any_case(spark, folder):
    (folder / "D2.CSV").write_text("name\ncarl\n")
    (folder / "J.Md").write_text("# Upper\n")
    (folder / "k.scss").write_text("a { b: c }\n")
    got = sorted(r["text"] for r in loaders.directory(spark, str(folder), [".csv", ".md", ".scss"]).collect())
    assert len(got) == 7 and "name: carl" in got and "# Upper\n" in got and "a { b: c }\n" in got
    assert loaders.load(spark, f"{folder}/k.scss").first()["metadata"]["language"] == "scss"


def test_csv_rows_and_encodings(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.csv").write_text("a,b\n" + "".join(f"v{n}x{i},{i}\n" for i in range(4000)))
    whole, lines = (loaders.csv(spark, str(tmp_path), multiline=m).collect() for m in (True, False))
    for rows in (whole, lines):
        assert sorted((r["file_name"], int(r["metadata"]["row"]), r["text"]) for r in rows) == sorted((f"{n}.csv", i, f"a: v{n}x{i}\nb: {i}") for n in range(3) for i in range(4000))
    for code, text in (("utf-8", "名,b\n值é,1\n"), ("gb18030", "名,b\n值,1\n"), ("iso-8859-1", "n,b\n\xe9\xff,1\n")):
        (tmp_path / "e").mkdir(exist_ok=True)
        (tmp_path / "e" / "x.csv").write_bytes(text.encode(code))
        assert loaders.detect_encoding(spark, f"{tmp_path}/e/x.csv") == code
        assert loaders.csv(spark, f"{tmp_path}/e/x.csv", encoding=None).first()["text"] == "\n".join(f"{k}: {v}" for k, v in zip(*[x.split(",") for x in text.split()], strict=True))


def test_office_data_source(spark, folder, monkeypatch):
    """Spark's own reader gives what the loaders give; filters leave files out before they are opened."""
    datasource.register(spark)
    (folder / "sub" / "deep.DOCX").write_bytes(DOCX)
    rows = lambda df: sorted((r["source"], r["file_name"], r["file_type"], r["text"], sorted(r["metadata"].items())) for r in df.collect())
    flat = spark.read.format("office").option("recursive", "false").load(str(folder))
    want = loaders.load_all(spark, [f"{folder}/{f}" for f in ("e.docx", "f.pptx", "g.docx")])
    assert rows(flat) == rows(want) and flat.schema == want.schema
    assert spark.read.format("office").load(str(folder)).count() == 4 and spark.read.format("office").load(f"{folder}/e.docx").first()["text"] == "First para\n\na | b"
    monkeypatch.setattr(datasource, "PARTITION_BYTES", 1)
    reader = datasource.OfficeReader({"path": str(folder)})
    assert [len(p.paths) for p in reader.partitions()] == [1, 1, 1, 1]
    few = spark.read.format("office").load(str(folder)).filter("file_type = 'pptx' and length(text) > 3")
    assert rows(few) == rows(loaders.pptx(spark, f"{folder}/f.pptx"))
    assert spark.read.format("office").load(str(folder)).filter("file_name in ('e.docx', 'g.docx') and source like '%e.docx'").count() == 1
    kept = list(reader.pushFilters([datasource.EqualTo(("file_type",), "docx"), datasource.EqualTo(("text",), "x")]))
    assert len(kept) == 1 and sorted(p.paths[0].rsplit("/", 1)[-1] for p in reader.partitions()) == ["deep.DOCX", "e.docx", "g.docx"]
    with pytest.raises(Exception, match="path"):
        spark.read.format("office").load().collect()


def test_errors_by_file(spark, folder):
    """Bytes that are no text are told of for text and CSV files as for others."""
    (folder / "bad.txt").write_bytes(b"fine \xff\xfe line")
    (folder / "bad.csv").write_bytes(b"a,b\n1,\xff\n2,x\n")
    (folder / "bad.py").write_bytes(b"x = '\xe9'\n")
    docs = loaders.load_all(spark, [f"{folder}/{f}" for f in ("bad.txt", "bad.csv", "bad.py", "a.md", "c.py", "d.csv", "e.docx", "g.docx")])
    told = {r["source"].rsplit("/", 1)[-1]: r["error"] for r in loaders.errors(docs).collect()}
    assert set(told) == {"bad.txt", "bad.csv", "bad.py", "g.docx"} and "UTF-8" in told["bad.txt"] and "encoding" in told["bad.csv"]


def test_a_test_set_in_one_file_is_bounded(spark, tmp_path):
    rows = spark.range(5).selectExpr("cast(id as string) question")
    sinks.testset_file(rows, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="over 4"):
        sinks.testset_file(rows, str(tmp_path / "u"), most=4)


def _records(spark, rows):
    return spark.createDataFrame(rows, K.RECORD)


def test_collection(spark, tmp_path):
    c = K.Collection(spark, str(tmp_path), "col")
    rows = [(str(i), f"text {i}", [float(i), 1.0], {"source": f"s{i % 2}", "n": str(i), "empty": None, "total_record_count": "9"}) for i in range(6)]
    assert c.count() == 0 and c.add(_records(spark, rows)) == 6 and c.add(_records(spark, rows[:2])) == 0
    assert set(c.read().first()["metadata"]) == {"source", "n"}
    c.upsert(_records(spark, [("0", "new", [0.0, 1.0], {"source": "s9"}), ("77", "more", [5.0, 5.0], {})]))
    c.update(_records(spark, [("1", "changed", [0.0, 1.0], {"source": "s1"}), ("404", "absent", [0.0, 0.0], {})]))
    got = {r["id"]: r["document"] for r in c.read().collect()}
    assert got["0"] == "new" and got["1"] == "changed" and "404" not in got and len(got) == 7
    assert c.delete(ids=["77"]) and not c.delete() and c.delete(filters={"source": "s0"}) and c.count() == 4
    q = spark.createDataFrame([(1, [5.0, 1.0])], "query_id long, query array<float>")
    assert c.search(q, 1).first()["id"] == "5" and c.search(q, 1, {"n": {"$lt": 4}}).first()["id"] != "5"
    assert c.scan(2).count() == 2 and c.read(0).count() == 6 and len(c.versions()) == 6
    # of two writers of one version the second fails and leaves no trace
    late = K.Collection(spark, str(tmp_path), "col")
    late.versions = lambda: c.versions()[:-1]
    before = sorted(c.read().collect())
    with pytest.raises(Exception, match="(?i)exist"):
        late.upsert(_records(spark, [("1", "late", [0.0, 1.0], {})]))
    assert sorted(c.read().collect()) == before
    c.compact()
    assert sorted(c.read().collect()) == before and len(c._folders()["data"]) == 1 and not c._folders()["gone"]
    c.upsert(_records(spark, [("1", "once more", [0.0, 1.0], {"source": "s1"})]))
    assert {r["id"]: r["document"] for r in c.read().collect()}["1"] == "once more" and c.count() == 4
    far = c.search(q, 4).orderBy("rank").collect()
    assert [r["score"] for r in far] == sorted((r["score"] for r in far), reverse=True)
    assert c.search(q, 4, threshold=far[1]["score"]).count() == 2
    assert K.Collection.names(spark, str(tmp_path)) == ["col"] and c.exists()
    assert not c.reset() and c.reset(confirm=True) and c.count() == 0


def test_upsert_takes_one_record_of_each_id(spark, tmp_path):
    c = K.Collection(spark, str(tmp_path), "up", embed=pipeline.hashing_encoder(8))
    new = spark.createDataFrame([("a", "z"), ("a", "y"), ("b", "x"), (None, "w")], "id string, document string")
    c.upsert(new)
    assert sorted((r["document"], len(r["embedding"])) for r in c.read().collect()) == [("w", 8), ("x", 8), ("y", 8)]
    c.upsert(new.withColumn("document", F.concat("document", F.lit("!"))).filter("id is not null"))
    got = {r["id"]: r["document"] for r in c.read().collect()}
    assert got["a"] == "y!" and got["b"] == "x!" and len(got) == 3
    c.upsert(spark.createDataFrame([("b", "v", {"k": None, "total_record_count": "9", "s": "1"})], "id string, document string, metadata map<string,string>"))
    assert c.read().filter("id = 'b'").first()["metadata"] == {"s": "1"} and c.count() == 3
    plain = K.Collection(spark, str(tmp_path), "plain")
    plain.upsert(new)
    assert plain.count() == 3 and plain.read().filter("embedding is not null").count() == 0


META = [
    ("a", {"page": "3", "ok": "true", "s": "x"}), ("b", {"page": "iv", "ok": "True"}), ("c", {"page": "3.0", "ok": "false"}), ("d", {"s": "3"}), ("e", {"page": "10", "s": "true"}),
    ("f", {"page": "-2.5"}), ("g", {"page": ""}), ("h", {}), ("i", {"page": "4", "s": "xy"}),
]
FILTERS = {
    "page = 3": ({"page": 3}, "ac"), "page in": ({"page": [3, 4, "iv"]}, "abci"), "page >= 2": ({"page": {"$gte": 2}}, "acei"), "page < 3.5": ({"page": {"$lt": 3.5}}, "acf"),
    "page <> 3": ({"page": {"$ne": 3}}, "befgi"), "page not in": ({"page": {"$nin": [3, "iv"]}}, "efgi"), "ok": ({"ok": True}, "a"), "not ok": ({"ok": {"$ne": True}}, "bc"), "s text": ({"s": "x"}, "a"),
    "s number": ({"s": 3}, "d"), "s > x": ({"s": {"$gt": "x"}}, "i"), "both": ({"$and": [{"page": {"$gt": 2, "$lt": 5}}, {"s": ["x", "xy"]}]}, "ai"), "either": ({"$or": [{"page": "iv"}, {"s": "3"}]}, "bd"),
    "either typed": ({"$or": [{"page": {"$gt": 9}}, {"s": "x"}]}, "ae"), "none in": ({"page": []}, ""), "no filter": ({}, "abcdefghi"),
}


def test_filters_on_mixed_metadata(spark, tmp_path):
    """With and without typed columns, and over folders of which only some have them."""
    rows = [(i, i, None, m) for i, m in META]
    plain, typed, mixed = (K.Collection(spark, str(tmp_path), n) for n in ("plain", "typed", "mixed"))
    typed.columns = {"page": "double", "s": "string"}
    plain.add(_records(spark, rows))
    typed.add(_records(spark, rows))
    mixed.add(_records(spark, rows[:4]))
    mixed.columns = {"page": "double"}
    mixed.add(_records(spark, rows[4:]))
    assert typed.typed() == {"page": "double", "s": "string"} and mixed.typed() == plain.typed() == {}
    for name, (f, want) in FILTERS.items():
        for c in (plain, typed, mixed):
            assert "".join(sorted(r["id"] for r in c.read(filters=f).collect())) == want, (name, c.name)
    pushed = typed.read(filters={"page": {"$gte": 2}, "s": "x"})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(m_page,2.0)" in pushed and "EqualTo(m_s,x)" in pushed
    assert plain.frequent_keys() == {"page": "string"} and plain.frequent_keys(0.1)["s"] == "string"
    mixed.compact({"page": "double"})
    assert mixed.typed() == {"page": "double"} and "".join(sorted(r["id"] for r in mixed.read(filters={"page": 3}).collect())) == "ac"
    assert typed.delete(filters={"page": {"$gt": 2}}) and "".join(sorted(r["id"] for r in typed.read().collect())) == "bdfgh"
    with pytest.raises(ValueError):
        K.Collection(spark, str(tmp_path), "x", columns={"page": "map"})


def test_knowledge_base(spark, tmp_path):
    kb = K.KnowledgeBase(K.Collection(spark, str(tmp_path), "kb"), pipeline.hashing_encoder(16))
    docs = spark.createDataFrame([("a", "some text here. " * 60), ("b", "other words. " * 10)], "source string, text string").withColumn("doc_id", F.col("source"))
    made = pipeline.ingest(docs, pipeline.build(size=100, overlap=10), kb.add_documents)
    assert made["documents"] == 2 and made["added"] == kb.collection.count() > 2
    assert kb.add_documents(spark.createDataFrame([("b", "x")], "source string, text string")) == 1
    s = kb.stats().first()
    assert s["sources"] == "a,b" and s["source_count"] == 2
    asked = spark.createDataFrame([(1, "other words"), (2, "some text here")], "query_id long, text string")
    found = {r["query_id"]: r for r in kb.search(asked, 1).collect()}
    assert found[1]["source"] == "b" and found[2]["source"] == "a" and "some text" in found[2]["content"]
    assert kb.search(asked, 50, threshold=0.99).count() < kb.search(asked, 50).count()
    changed = kb.collection.read().filter("document = 'x'").select("id", F.lit("b").alias("source"), F.lit("y").alias("text"))
    kb.update_document(changed)
    new = kb.collection.read().filter("document in ('x', 'y')").collect()
    assert [r["document"] for r in new] == ["y"] and "updated_at" in new[0]["metadata"] and "added_at" not in new[0]["metadata"]
    again = K.KnowledgeBase.open(spark, str(tmp_path), "kb")
    assert again.exists() and not K.KnowledgeBase.open(spark, str(tmp_path), "none").exists()
    (tmp_path / "new.txt").write_text("fresh file text")
    assert again.add_files([str(tmp_path / "new.txt"), str(tmp_path / "gone.txt")], lambda df: df.withColumn("chunk_index", F.lit(0))) == 1
    kb.collection.embed = kb.embed
    assert kb.delete(ids=[new[0]["id"]])
    assert kb.delete_by_source("a") and "a" not in kb.stats().first()["sources"].split(",")
    with pytest.raises(ValueError):
        pipeline.build("other")
    for kind in ("markdown", "parent_child"):
        assert pipeline.build(kind, 100, 10)(docs).count() >= 2


def test_reports_and_sinks(spark, tmp_path):
    samples = spark.createDataFrame([("what is a cat", "a cat is an animal", "a cat is an animal", ["cats are animals", "a cat is an animal"]), ("q", "a", None, ["c"])], "question string, answer string, ground_truth string, contexts array<string>")
    scores = evaluate.evaluate(samples)
    assert scores.filter("ground_truth is null").first()["context_recall"] is None
    long = evaluate.long_form(scores, ["question", "answer"], ["faithfulness", "context_recall"])
    s = report.summarise(long, evaluate.WEIGHTS)
    for kind in ("text", "markdown", "html", "json"):
        body = report.render(s, long, kind)
        assert "faithfulness" in body and str(s["overall"]) in body
    assert report.grade(0.85) == "excellent" and report.grade(0.1) == "poor" and report.grade(None) == "unknown"
    sinks.text_file(spark, str(tmp_path / "r"), "body")
    sinks.csv(long, str(tmp_path / "c"))
    sinks.json_rows(long, str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == long.count()
    (tmp_path / "t.json").write_text(json.dumps([{"question": "问"}, {"question": "b", "answer": "c"}], ensure_ascii=False))
    got = loaders.testset(spark, str(tmp_path / "t.json")).orderBy("question").collect()
    assert [(r["question"], r["answer"]) for r in got] == [("b", "c"), ("问", "")]
    many = spark.range(50).select(F.concat(F.lit("q\n["), "id").alias("question"), F.when(F.col("id") % 2 == 0, "a").alias("answer"), F.lit("c").alias("ground_truth_context"), F.create_map(F.lit("n"), F.col("id").cast("string")).alias("metadata"))
    want = sorted((f"q\n[{i}", "" if i % 2 else "a", str(i)) for i in range(50))
    for write in (sinks.testset, sinks.testset_file):
        write(many, str(tmp_path / write.__name__))
        back = loaders.testset(spark, str(tmp_path / write.__name__)).collect()
        assert sorted((r["question"], r["answer"], r["metadata"]["n"]) for r in back) == want
    assert len(json.loads(next((tmp_path / "testset_file").glob("part-*")).read_text())) == 50
    paths = report.save(s, long, str(tmp_path / "reports"))
    assert len(paths) == 4 and spark.read.json(paths["details"]).count() == long.count()


def test_streaming_ingest(spark, tmp_path):
    landing, out = tmp_path / "in", []
    landing.mkdir()
    for i, body in enumerate(["one text", "one text", "another"]):
        (landing / f"{i}.txt").write_text(body)
    stream = ingest.once(ingest.documents(spark, str(landing), "*.txt"))
    q = ingest.ingest(stream, lambda df: df.select("text"), lambda df: out.extend(r["text"] for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(out) == ["another", "one text"]


def test_settings(monkeypatch):
    monkeypatch.setenv("LQ_X", "7")
    assert config.resolve({"a": ["${LQ_X}", "${LQ_UNSET}"]}) == {"a": ["7", "${LQ_UNSET}"]}
    assert config.Settings().retrieval.rrf_k == 60


def test_a_collection_follows_a_stream(spark, tmp_path):
    """Inserts, updates and nothing; a batch run again and a restart change nothing."""
    c = K.Collection(spark, str(tmp_path), "followed")
    (tmp_path / "in").mkdir()
    stamp = iter(range(1, 100))

    def land(*rows):
        n = next(stamp)
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps({"id": i, "text": t, "arrived": f"2024-01-01T00:00:{n + k:02}"}) + "\n" for k, (i, t) in enumerate(rows)))

    def run():
        stream = spark.readStream.schema("id string, text string, arrived timestamp").json(str(tmp_path / "in"))
        ingest.follow(stream, c, str(tmp_path / "checkpoint")).awaitTermination()
        return {r["id"]: (r["document"], r["metadata"].get("change")) for r in c.read().collect()}

    land(("a", "one"), ("b", "two"), ("a", "three"), (None, "x"), ("n", None))
    assert run() == {"a": ("three", "insert"), "b": ("two", "insert"), "n": ("", "insert")}
    land(("b", "two"), ("c", "four"))
    land(("a", "five"))
    assert run() == {"a": ("five", "update"), "b": ("two", "insert"), "c": ("four", "insert"), "n": ("", "insert")}
    versions = c.versions()
    assert run()["a"] == ("five", "update") and c.versions() == versions
    last = c._folders()["streams"]["landing"]
    again = spark.createDataFrame([("a", "replayed")], "id string, document string")
    assert not c.upsert(again, once=("landing", last)) and not c.upsert(again, once=("landing", 0)) and c.versions() == versions
    c.compact()
    assert not c.upsert(again, once=("landing", last)) and c.upsert(again, once=("landing", last + 1)) and run()["b"] == ("two", "insert")
