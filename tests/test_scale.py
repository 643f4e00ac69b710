"""What a query holds, hands back or shuffles stays bounded, and folders of files are read like one file."""

import re

from loomquery.operators import bm25, dedup, ivf, knn, split
from loomquery.queries import QUERIES


def test_recall_is_held_against_brute_force(spark, sf, tmp_path, monkeypatch):
    """No search deals its queries to all lists, and a batch of probes is of bounded size."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    index = ivf.VectorIndex.build(e, str(tmp_path / "index"), lists=12)
    asked, search = [], ivf.VectorIndex.search
    monkeypatch.setattr(ivf.VectorIndex, "search", lambda self, q, k=10, probes=None, live=None: (asked.append(probes), search(self, q, k, probes, live))[1])
    queries = e.filter("vec_id % 100 = 0").selectExpr("vec_id query_id", "embedding query")
    assert index.recall(queries, probes=12) == 1.0 and asked == [12]
    assert index.recall(queries) >= 0.5 and asked == [12, None]
    index.probes_for(0.9)
    assert asked == [12, None]


def test_stream_of_a_folder_of_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["kb_follow_stream"](spark, str(tmp_path)).collect()
    want = docs.selectExpr("doc_id", "md5(text)").collect()
    assert sorted((r.doc_id, r.text_md5) for r in got) == sorted(map(tuple, want)) and {(r.change, r.changed_again) for r in got} == {("insert", 0)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_splitters_hand_back_bounded_batches(spark, sf, monkeypatch):
    """Whatever a task gathers before it hands chunks back, the chunks are the same; no array of all chunks of a batch is made."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").limit(40)
    made = (split.recursive, split.markdown, split.parent_child)
    want = [sorted(map(tuple, f(docs).collect()), key=repr) for f in made]
    monkeypatch.setattr(split, "HELD", 300, raising=False)
    for f, rows in zip(made, want, strict=True):
        assert sorted(map(tuple, f(docs).collect()), key=repr) == rows and len(rows) > 40
        assert "MapInArrow" in _plan(f(docs)) and "ArrowEvalPython" not in _plan(f(docs))


def test_parents_are_counted_by_hash(spark):
    """A parent is not sorted once for each child; children of one key with other texts still count together."""
    children = spark.createDataFrame([(1, 0, "b"), (1, 0, "a"), (1, 0, "a"), (1, 1, "c"), (None, 0, "d")], "doc_id long, parent_index int, parent_content string")
    found = split.parents(children)
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, 0, "a", 3), (1, 1, "c", 1), (None, 0, "d", 1)]
    assert "HashAggregate" in _plan(found).split("partial_count(1)")[0].splitlines()[-1]


def test_similar_pairs_shuffle_grows_like_the_vectors(spark, sf, monkeypatch):
    """Ten times the vectors are sent to as many blocks, unless these would be too large; the pairs don't depend on the blocks."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = sorted(map(tuple, dedup.similar_pairs(e, 0.3).collect()))
    monkeypatch.setattr(dedup, "GRID", 3, raising=False)
    dealt, counts = dedup._dealt, []
    monkeypatch.setattr(dedup, "_dealt", lambda rows, n: (counts.append(dealt(rows, n).count() / rows.count()), dealt(rows, n))[1])
    assert sorted(map(tuple, dedup.similar_pairs(e, 0.3, block=20).collect())) == want and len(want) > 10
    monkeypatch.setattr(dedup, "LARGEST", 100, raising=False)
    assert sorted(map(tuple, dedup.similar_pairs(e, 0.3, block=20).collect())) == want
    assert counts == [3, 5]


def test_similarity_matrix_multiplies_matrices(spark, sf, monkeypatch):
    """Blocks meet as matrices, in bounded batches, and null vectors keep their rows."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").limit(70)
    e = e.unionByName(spark.sql("select 900l vec_id, cast(null as array<float>) embedding union all select 901l, transform(sequence(1, 64), i -> if(i = 3, null, cast(i as float)))"))
    plain = {(a.vec_id, b.vec_id): None if None in (a.embedding or [None]) + (b.embedding or [None]) else sum(x * y for x, y in zip(a.embedding, b.embedding)) for a in e.collect() for b in e.collect()}
    size = {k[0]: v**0.5 for k, v in plain.items() if k[0] == k[1] and v is not None}
    monkeypatch.setattr(knn, "PAIRS", 500, raising=False)
    monkeypatch.setattr(knn, "PAIRS_BATCH", 300, raising=False)
    monkeypatch.setattr(knn, "BLOCK", 25)
    found = knn.similarity_matrix(e, e)
    got = {(r.id_a, r.id_b): r.similarity for r in found.collect()}
    assert got.keys() == plain.keys() and "MapInArrow" in _plan(found)
    assert all((got[k] is None) if v is None else abs(got[k] - v / (size[k[0]] * size[k[1]] + 1e-8)) < 2e-6 for k, v in plain.items())


def test_keyword_scores_meet_by_document(spark, sf, monkeypatch):
    """Sums of a query and a document are not shuffled, and more pairs are more tasks, with the same rows."""
    for name in ("bm25_batch", "bm25_index_search"):
        monkeypatch.undo()
        found = QUERIES[name](spark, sf)
        assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", _plan(found))
        want = sorted(map(tuple, found.collect()))
        monkeypatch.setattr(bm25, "PAIRS", 20_000, raising=False)
        monkeypatch.setattr(bm25, "NAMED", 3, raising=False)
        again = QUERIES[name](spark, sf)
        assert sorted(map(tuple, again.collect())) == want and "REPARTITION_BY_NUM" in _plan(again)


def test_nfkc_takes_bounded_pieces(spark):
    """A worker holds about a megabyte of texts as strings, whatever the number of rows or the length of each."""
    import unicodedata

    import pyarrow as pa

    from loomquery.functions import text as X

    texts = [None, "", "ﬁ①Ａ", "e\u0301" * 700_000, *["ﾊﾞ ü"] * 400_000, None, "x"]
    pieces = X._pieces(pa.array(texts))
    longest = max(len(t.encode()) for t in texts if t)
    assert sum((p.to_pylist() for p in pieces), []) == texts and max(sum(len(t.encode()) for t in p.to_pylist() if t) for p in pieces) < X.PIECE + longest and len(pieces) > 4
    assert X._pieces(pa.array([], pa.string()))[0].to_pylist() == [] and X._pieces(pa.array([None], pa.string()))[0].to_pylist() == [None]
    few = list(enumerate([*texts[:4], *texts[-3:]]))
    got = spark.createDataFrame(few, "i int, t string").select("i", X.nfkc("t").alias("t")).collect()
    assert dict(map(tuple, got)) == {i: t and unicodedata.normalize("NFKC", t) for i, t in few}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20
