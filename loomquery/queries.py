"""The catalogue: each query as a Spark plan and, where SQL can say it, as DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomquery.functions import metrics as M
from loomquery.functions import text as X
from loomquery.functions import vector as V
from loomquery.operators import bm25, dedup, evaluate, fusion, ivf, knn, rewrite, segments, split
from loomquery.plans import rag
from loomquery.plans.tables import own_dir, top, with_group_size
from loomquery.sources import collections as K
from loomquery.sources import loaders, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL pieces ------------------------------------------------------------------------------------------------

_STRIP = r"regexp_replace({c}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"


def _strip(c: str) -> str:
    return _STRIP.replace("{c}", c)


def _tok(c: str) -> str:
    return rf"list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: trim(x) <> '')"


def _set(c: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(lower({c}), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))"


_BENCH = "select item_id query_id, text query from benchmark"
_ONE = "select 0::bigint query_id, 'the and thble heit mente the' query"


def _bm25_sql(queries: str = _ONE, k: int = 10, idf: str = "ratio", threshold: float | None = None, where: str = "true") -> str:
    ratio = "(n - df + 0.5) / (df + 0.5)"
    weight = f"greatest(0.0, {ratio})" if idf == "ratio" else f"ln(1 + {ratio})"
    cut = f"where score_raw / m >= {threshold}" if threshold is not None else ""
    return f"""
    with q as ({queries}), d as (select doc_id, ({where}) keep, {_tok("text")} toks from documents),
    st as (select count(*) n, sum(len(toks))::double / greatest(count(*), 1) a from d),
    qt as (select query_id, token, count(*) qtf from (select query_id, unnest({_tok("query")}) token from q) group by all),
    p as (select doc_id, token, count(*) tf from (select doc_id, unnest(toks) token from d) where token in (select token from qt) group by all),
    lx as (select token, count(*) df from p group by all),
    s as (select query_id, d.doc_id, round(sum(qtf * {weight} * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len(toks) / greatest(a, 1.0)))), 6) score_raw
      from p join lx using (token) join qt using (token) join d using (doc_id), st where keep group by all),
    m as (select *, max(score_raw) over (partition by query_id) m from s where score_raw > 0),
    r as (select *, row_number() over (partition by query_id order by score_raw desc, doc_id) rank from m {cut})
    select query_id, doc_id, round(score_raw / m, 6) score, score_raw, rank::int rank from r where rank <= {k}"""


def _one(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "the and thble heit mente the")], "query_id long, query string")


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# Keyword search --------------------------------------------------------------------------------------------


@query(_bm25_sql())
def bm25_topk(spark, sf_dir):
    return bm25.search(t(spark, sf_dir, "documents"), _one(spark), 10)


@query(_bm25_sql())
def bm25_default_k(spark, sf_dir):
    """Zero asks for the default number of results."""
    return bm25.search(t(spark, sf_dir, "documents"), _one(spark), 0)


@query(_bm25_sql(idf="okapi"))
def bm25_okapi_topk(spark, sf_dir):
    return bm25.search(t(spark, sf_dir, "documents"), _one(spark), 10, idf_kind="okapi")


@query(_bm25_sql(threshold=0.5, k=20))
def bm25_threshold(spark, sf_dir):
    return bm25.search(t(spark, sf_dir, "documents"), _one(spark), 20, threshold=0.5)


@query(_bm25_sql(where="lang = 'de'"))
def bm25_filtered(spark, sf_dir):
    return bm25.search(t(spark, sf_dir, "documents"), _one(spark), 10, where=F.col("lang") == "de")


@query(_bm25_sql(_BENCH))
def bm25_batch(spark, sf_dir):
    return bm25.search(t(spark, sf_dir, "documents"), _bench(spark, sf_dir), 10)


@query(_bm25_sql(_BENCH, k=5))
def bm25_index_search(spark, sf_dir):
    """The same scores from a built index."""
    return bm25.Index.build(t(spark, sf_dir, "documents")).search(_bench(spark, sf_dir), 5)


_STOP = [*bm25.STOPWORDS, "the", "and", "la", "die"]


@query(_bm25_sql().replace(_tok("text"), f"list_filter({_tok('text')}, lambda x: x not in {tuple(_STOP)!r})"))
def bm25_stopwords(spark, sf_dir):
    """Stopwords count neither as terms nor in lengths."""
    return bm25.search(t(spark, sf_dir, "documents"), _one(spark), 10, stopwords=_STOP)


@query(f"""
    with p as (select doc_id, token, count(*) tf from (select doc_id, unnest({_tok("text")}) token from documents) group by all),
    n as (select count(*) n from documents)
    select token, count(*) df, round(greatest(0.0, (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) idf from p, n group by token""")
def bm25_lexicon(spark, sf_dir):
    return bm25.Index.build(t(spark, sf_dir, "documents")).terms().select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"select doc_id, len({_tok('text')})::bigint dl from documents")
def bm25_doclen(spark, sf_dir):
    return bm25.Index.build(t(spark, sf_dir, "documents")).lengths


@query(f"""
    with p as (select doc_id, token from (select doc_id, unnest({_tok("text")}) token from documents) group by all),
    l as (select token, greatest(0.0, ((select count(*) from documents) - count(*) + 0.5) / (count(*) + 0.5)) idf from p group by token),
    w as (select {_tok("'the thble unseenword of the'")} w), q as (select unnest(w) token, generate_subscripts(w, 1) pos from w)
    select token, round(coalesce(idf, 0.0), 6) idf from q left join l using (token) order by coalesce(idf, 0.0) desc, pos limit 4""")
def bm25_relevant_terms(spark, sf_dir):
    index = bm25.Index.build(t(spark, sf_dir, "documents"))
    return bm25.relevant_terms(index, "the thble unseenword of the", spark, 4).select("token", F.round("idf", 6).alias("idf"))


def _segments(spark, sf_dir) -> segments.SegmentedIndex:
    """All documents in three batches: one of them came with other texts first, another was deleted in between, and two are merged."""
    docs, index = t(spark, sf_dir, "documents").select("doc_id", "text", "lang"), segments.SegmentedIndex(spark, f"{own_dir(spark)}/segments-{uuid.uuid4().hex}")
    en, de, other = docs.filter("lang = 'en'"), docs.filter("lang = 'de'"), docs.filter("lang not in ('en', 'de') or lang is null")
    for batch in (en, de.withColumn("text", F.reverse("text")), other):
        index.add(batch)
    index.delete(other.select("doc_id"))
    index.add(de)
    index.merge(below=en.count())
    index.add(other)
    return index


@query(_bm25_sql(_BENCH))
def segments_search(spark, sf_dir):
    return _segments(spark, sf_dir).search(_bench(spark, sf_dir), 10)


@query(f"""
    select token, count(*) df from (select unnest(list_distinct({_tok("text")})) token from documents) group by token""")
def segments_lexicon(spark, sf_dir):
    return _segments(spark, sf_dir).lexicon()


# Vector search ---------------------------------------------------------------------------------------------

_DIST = {
    "cosine": "1 - list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)) + 1e-8)",
    "l2": "sqrt(list_sum(list_transform(list_zip(a, b), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))",
    "l1": "list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2])))",
}


def _knn_sql(metric: str = "cosine", k: int = 10, where: str = "true", queries: str = "vec_id % 100 = 0") -> str:
    return f"""
    with v as (select vec_id, label, embedding::double[] a from embeddings where {where}), q as (select vec_id query_id, embedding::double[] b from embeddings where {queries}),
    s as (select query_id, vec_id, round({_DIST[metric]}, 6) distance from v, q)
    select query_id, vec_id, distance, rank::int rank from (select *, row_number() over (partition by query_id order by distance, vec_id) rank from s) where rank <= {k}"""


def _vq(spark, sf_dir, cond="vec_id % 100 = 0"):
    return t(spark, sf_dir, "embeddings").filter(cond).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(_knn_sql(queries="vec_id = 0"))
def knn_cosine(spark, sf_dir):
    return knn.search(t(spark, sf_dir, "embeddings"), _vq(spark, sf_dir, "vec_id = 0"))


@query(_knn_sql("l2"))
def knn_l2(spark, sf_dir):
    return knn.search(t(spark, sf_dir, "embeddings"), _vq(spark, sf_dir), metric="l2")


@query(_knn_sql("l2"))
def knn_alias(spark, sf_dir):
    """A metric by another of its names, in any case."""
    return knn.search(t(spark, sf_dir, "embeddings"), _vq(spark, sf_dir), 0, metric="Euclidean")


@query(_knn_sql("l1"))
def knn_l1(spark, sf_dir):
    return knn.search(t(spark, sf_dir, "embeddings"), _vq(spark, sf_dir), metric="l1")


@query(_knn_sql())
def knn_batch(spark, sf_dir):
    return knn.search(t(spark, sf_dir, "embeddings"), _vq(spark, sf_dir))


def _index(spark, sf_dir) -> ivf.VectorIndex:
    return ivf.VectorIndex.build(t(spark, sf_dir, "embeddings"), f"{own_dir(spark)}/vectors-{uuid.uuid4().hex}")


@query()
def vector_index_search(spark, sf_dir):
    """Approximate: the lists that each query probes. Its recall is ``vector_index_recall``."""
    return _index(spark, sf_dir).search(_vq(spark, sf_dir)).withColumnRenamed("id", "vec_id")


@query(_knn_sql())
def vector_index_exact(spark, sf_dir):
    """Every list probed: what ``knn_batch`` finds, so that no row is missing from the index."""
    index = _index(spark, sf_dir)
    return index.search(_vq(spark, sf_dir), probes=len(index.centroids)).withColumnRenamed("id", "vec_id")


@query("select 10 k, count(*) rows_indexed, true recall_reached, true fewer_rows_read from embeddings")
def vector_index_recall(spark, sf_dir):
    """Whether 0.9 of the exact ten nearest are found, and whether a query is compared with fewer rows than there are.

    The queries are every hundredth row, against all rows.
    """
    index = _index(spark, sf_dir)
    read = index.probes < len(index.centroids) or index.about["rows"] < 2
    found = F.lit(index.recall(_vq(spark, sf_dir)) >= 0.9)
    return index.rows().agg(F.lit(10).alias("k"), F.count("*").alias("rows_indexed"), found.alias("recall_reached"), F.lit(read).alias("fewer_rows_read"))


@query(_knn_sql(where="label in (1, 2, 3)", k=5))
def knn_filtered(spark, sf_dir):
    return knn.search(t(spark, sf_dir, "embeddings"), _vq(spark, sf_dir), 5, where=F.col("label").isin(1, 2, 3))


@query(f"""
    with r as ({_knn_sql(k=10)}) select query_id, vec_id, distance, round(greatest(0.0, 1 - distance), 6) score, rank from r where round(greatest(0.0, 1 - distance), 6) >= 0.5""")
def knn_threshold(spark, sf_dir):
    """The threshold comes after the top k: fewer rows may be left."""
    found = knn.search(t(spark, sf_dir, "embeddings"), _vq(spark, sf_dir)).withColumn("score", F.round(V.score(F.col("distance"), clamp=True), 6))
    return found.filter("score >= 0.5")


@query(f"""
    with r as ({_knn_sql(k=10)}), c as (select r.*, label content from r join embeddings using (vec_id)),
    o as (select *, row_number() over (partition by query_id, content order by distance, vec_id) n from c),
    s as (select query_id, vec_id, content, distance, round(greatest(0.0, 1 - distance), 6) score from o where n = 1)
    select *, (row_number() over (partition by query_id order by score desc, vec_id))::int rank from s where score >= 0.1""")
def semantic_retrieve(spark, sf_dir):
    """Retrieval with one result per content (here the label)."""
    e = t(spark, sf_dir, "embeddings")
    out = knn.retrieve(e, _vq(spark, sf_dir), e.select("vec_id", F.col("label").alias("content")), 10, threshold=0.1)
    return out.select("query_id", "vec_id", "content", "distance", "score", "rank")


@query(f"""
    with r as ({_knn_sql("l2", 3)}) select query_id, vec_id, round(1 / (1 + distance), 6) score, rank from r""")
def distance_score(spark, sf_dir):
    found = knn.search(t(spark, sf_dir, "embeddings"), _vq(spark, sf_dir), 3, "l2")
    return found.select("query_id", "vec_id", F.round(V.score(F.col("distance"), "l2"), 6).alias("score"), "rank")


@query(f"""
    with q as (select vec_id, embedding::double[] b from embeddings where vec_id % 100 = 0), v as (select vec_id, embedding::double[] a from embeddings)
    select v.vec_id id_a, q.vec_id id_b, round(1 - ({_DIST["cosine"]}), 6) similarity from v, q""")
def similarity_matrix(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    return knn.similarity_matrix(e, e.filter("vec_id % 100 = 0"))


@query("""
    with v as (select vec_id, embedding::double[] a, sqrt(list_inner_product(embedding::double[], embedding::double[])) n from embeddings)
    select vec_id, round(n, 6) norm, round(list_sum(list_transform(a, lambda x: x / n)), 6) total from v""")
def l2_normalize(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(V.norm("embedding"), 6).alias("norm"), F.round(F.aggregate(V.normalize("embedding"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""
    select label, round(avg(x), 6) mean, dim from (select label, unnest(embedding::double[]) x, generate_subscripts(embedding, 1)::int dim from embeddings) group by all""")
def mean_pooling(spark, sf_dir):
    """The mean vector of each label, as rows of (label, dim, mean)."""
    rows = t(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    return rows.groupBy("label", (F.col("i") + 1).alias("dim")).agg(F.round(F.avg("x"), 6).alias("mean"))


@query("""
    select vec_id, d::int dim, round((select avg(embedding[k * 8 + d]::double) from (values (1), (2), (4), (5), (7)) v(k)), 6) mean from embeddings, (select unnest(range(1, 9)) d)""")
def mean_pool_masked(spark, sf_dir):
    """Each vector as eight token vectors of eight numbers, pooled where a mask lets them through."""
    states = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (k % 3 != 0).cast("double"))
    pooled = t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.mean_pool(states, mask)).alias("i", "x"))
    return pooled.select("vec_id", (F.col("i") + 1).cast("int").alias("dim"), F.round("x", 6).alias("mean"))


# Fusion, hybrid, rerank ------------------------------------------------------------------------------------

# a query is a benchmark item; its vector is that of the document with its number
def _sem(k: int = 10) -> str:
    return f"select query_id, vec_id doc_id, 1 - distance score, rank from ({_knn_sql(k=k, queries='vec_id in (select item_id from benchmark)')})"


def _key(k: int = 10) -> str:
    return f"select query_id, doc_id, score, rank from ({_bm25_sql(_BENCH, k=k)})"


_SEM, _KEY = _sem(), _key()


def _keywords(spark, sf_dir, k: int = 10):
    return bm25.search(t(spark, sf_dir, "documents"), _bench(spark, sf_dir), k).select("query_id", "doc_id", "score", "rank")


def _legs(spark, sf_dir, k: int = 10):
    items = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    e = t(spark, sf_dir, "embeddings")
    q = e.join(items, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    sem = knn.search(e, q, k).select("query_id", F.col("vec_id").alias("doc_id"), (1 - F.col("distance")).alias("score"), "rank")
    return sem, _keywords(spark, sf_dir, k)


def _rrf_sql(ws: float, wk: float, k: int, fetch: int = 10) -> str:
    return f"""
    with a as ({_sem(fetch)}), b as ({_key(fetch)}), u as (select query_id, doc_id, {ws}::double w, rank from a union all select query_id, doc_id, {wk}::double, rank from b),
    f as (select query_id, doc_id, round(sum(w / (60 + rank)), 8) score from u group by all)
    select query_id, doc_id, score, rank::int rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from f) where rank <= {k}"""


@query(_rrf_sql(1.0, 1.0, 10))
def rrf_fusion(spark, sf_dir):
    sem, key = _legs(spark, sf_dir)
    return fusion.rrf({"semantic": sem, "keyword": key}, limit=10)


@query(f"""
    with f as ({_rrf_sql(0.7, 0.3, 10)}), a as ({_SEM}), b as ({_KEY}),
    own as (select query_id, doc_id, max(score) own from (select query_id, doc_id, score from a union all select query_id, doc_id, score from b) group by all),
    l as (select query_id, count(distinct leg) legs from (select query_id, 1 leg from a union all select query_id, 2 from b) group by all),
    s as (select query_id, doc_id, case when legs = 1 then own else score end score from f join l using (query_id) join own using (query_id, doc_id))
    select query_id, doc_id, score, rank::int rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from s) where rank <= 5""")
def hybrid_search(spark, sf_dir):
    return fusion.hybrid(*_legs(spark, sf_dir, fusion.over_fetch(5)), k=5)


@query(f"select query_id, doc_id, score, rank from ({_KEY}) where rank <= 5")
def hybrid_single_leg(spark, sf_dir):
    return fusion.hybrid(None, _keywords(spark, sf_dir), k=5)


@query(_rrf_sql(0.25, 0.75, 7, fusion.over_fetch(7)))
def hybrid_weighted(spark, sf_dir):
    sem, key = _legs(spark, sf_dir, fusion.over_fetch(7))
    ws, wk = fusion.normal_weights(1, 3)
    return fusion.rrf({"semantic": sem, "keyword": key}, {"semantic": ws, "keyword": wk}, limit=7)


@query(f"""
    with b as ({_KEY}), w as (select *, min(score) over (partition by query_id) lo, max(score) over (partition by query_id) hi from b),
    s as (select query_id, doc_id, round(case when hi > lo then (score - lo) / (hi - lo) else score end, 6) score from w)
    select query_id, doc_id, score, rank::int rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from s) where rank <= 5""")
def simple_rerank(spark, sf_dir):
    return fusion.simple_rerank(_keywords(spark, sf_dir), 5)


@query(f"""
    with b as ({_KEY}), j as (select query_id, doc_id, {_set("bm.text")} q, {_set("d.text")} c from b join benchmark bm on bm.item_id = query_id join documents d using (doc_id)),
    s as (select query_id, doc_id, round(len(list_intersect(q, c)) / greatest(len(q), 1), 6) score from j)
    select query_id, doc_id, score, (row_number() over (partition by query_id order by score desc, doc_id))::int rank from s""")
def lexical_rerank(spark, sf_dir):
    """Pair scores by the share of the query's words."""
    key = _keywords(spark, sf_dir).drop("score")
    q = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    pairs = key.join(q, "query_id").join(t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    return fusion.rerank(pairs).select("query_id", "doc_id", "score", "rank")


@query(f"select query_id, doc_id, score, rank from ({_KEY}) where score >= 0.3 and score <= 0.9")
def filter_results(spark, sf_dir):
    return fusion.filter_results(_keywords(spark, sf_dir), 0.3, 0.9)


@query(f"select query_id, string_agg(text, chr(10) || chr(10) order by rank) context from ({_KEY}) join documents using (doc_id) where rank <= 3 group by query_id")
def context_concat(spark, sf_dir):
    best = fusion.top_k(_keywords(spark, sf_dir), 3).join(t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return fusion.context(best, F.col("text"))


@query(f"""
    select query_id, string_agg('[文档 ' || rank || '] 来源: ' || source || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) context
    from ({_KEY}) join documents using (doc_id) where rank <= 3 group by query_id""")
def format_context(spark, sf_dir):
    best = fusion.top_k(_keywords(spark, sf_dir), 3).join(t(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("content")), "doc_id")
    return rag.format_contexts(best)


# Cleaning --------------------------------------------------------------------------------------------------


def _whitespace_sql(c: str) -> str:
    return _strip(rf"regexp_replace(regexp_replace(replace({c}, chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


@query(f"select page_id, {_whitespace_sql('html')} text from pages")
def clean_whitespace(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", X.whitespace("html").alias("text"))


@query("select page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') text from pages")
def strip_html(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", X.strip_html("html").alias("text"))


@query(r"select doc_id, regexp_replace(text, '[\x00-\x1f\x7f-\x9f\x{200b}-\x{200f}\x{2028}-\x{202f}\x{feff}]', ' ', 'g') text from documents")
def special_chars(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.special_chars("text").alias("text"))


@query(f"select page_id, {_whitespace_sql("regexp_replace(html, '<[^>]+>', ' ', 'g')")} text from pages")
def clean_pages(spark, sf_dir):
    """The cleaner with its defaults. The SQL has no NFKC, so equality also shows that these pages are normal."""
    return t(spark, sf_dir, "pages").select("page_id", X.clean("html").alias("text"))


@query()
def clean_full(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.clean_cjk("text").alias("text"))


@query(f"select page_id, {_whitespace_sql("regexp_replace(html, '<[^>]+>', ' ', 'g')")} text from pages")
def clean_documents(spark, sf_dir):
    return X.clean_documents(t(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")))


@query(f"select page_id, regexp_replace(lower({_whitespace_sql("regexp_replace(html, '<[^>]+>', ' ', 'g')")}), '[0-9]+', '#', 'g') || '.' text from pages")
def clean_custom(spark, sf_dir):
    """Cleaners of one's own run after the others, in their order."""
    own = [lambda c: F.regexp_replace(c, "[0-9]+", "#"), lambda c: F.concat(c, F.lit("."))]
    return t(spark, sf_dir, "pages").select("page_id", X.clean("html", lower=True, custom=own).alias("text"))


@query("select doc_id, lower(text) text from documents")
def lowercase(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))


_FULL = "".join(chr(i) for i in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(i) for i in range(0x21, 0x7F)) + " "
# whole documents with CJK marks around and full-width letters, commas and stops inside
_CJK = "select doc_id, '「' || coalesce(source, '') || '」『' || lang || '』“x”‘y’（z）【1】《b》——' || translate(text, 'aeiou,.! ', 'ａｅｉｏｕ，．！　') || '…' s from documents"


def _cjk(spark, sf_dir):
    wide = F.translate("text", "aeiou,.! ", "ａｅｉｏｕ，．！　")
    marked = F.concat(F.lit("「"), F.coalesce("source", F.lit("")), F.lit("」『"), "lang", F.lit("』“x”‘y’（z）【1】《b》——"), wide, F.lit("…"))
    return t(spark, sf_dir, "documents").select("doc_id", marked.alias("s"))


@query(f"select doc_id, translate(s, '{_FULL}', '{_HALF.replace(chr(39), chr(39) * 2)}') text from ({_CJK})")
def fullwidth(spark, sf_dir):
    return _cjk(spark, sf_dir).select("doc_id", X.half_width("s").alias("text"))


@query(f"select doc_id, replace(replace(translate(s, '（）【】《》', '()[]<>'), '——', '--'), '…', '...') text from ({_CJK})")
def cjk_punct(spark, sf_dir):
    return _cjk(spark, sf_dir).select("doc_id", X.cjk_punct("s").alias("text"))


@query(f"select doc_id, translate(s, '「」『』“”‘’', '\"\"\'\'\'\'\"\"\'\'\'\'') text from ({_CJK})")
def cjk_quotes(spark, sf_dir):
    return _cjk(spark, sf_dir).select("doc_id", X.cjk_quotes("s").alias("text"))


_CJK_CLEAN = f"replace(replace(translate(translate(translate(regexp_replace(s, '<[^>]+>', ' ', 'g'), '「」『』“”‘’', '\"\"\'\'\'\'\"\"\'\'\'\''), '{_FULL}', '{_HALF.replace(chr(39), chr(39) * 2)}'), '（）【】《》', '()[]<>'), '——', '--'), '…', '...')"


@query(f"select doc_id, {_whitespace_sql(_CJK_CLEAN)} text from ({_CJK})")
def clean_cjk(spark, sf_dir):
    """The whole cleaner for Chinese text but for NFKC, which SQL lacks."""
    return _cjk(spark, sf_dir).select("doc_id", X.clean_cjk("s", normalize=False).alias("text"))


@query("select doc_id, case when length(text) > 200 then substring(text, 1, 197) || '...' else text end text from documents")
def truncate(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.truncate("text", 200).alias("text"))


@query("select doc_id, case when length(text) > 8000 then substring(text, 1, 8000) || chr(10) || chr(10) || '[上下文已被截断...]' else text end text from documents")
def truncate_context(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.truncate_context("text").alias("text"))


@query("select doc_id, md5(text) md5, sha256(text) sha256 from documents")
def text_hash(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.text_hash("text").alias("md5"), X.text_hash("text", "sha256").alias("sha256"))


@query(r"""
    select doc_id, floor(1.5 * (length(text) - length(o)) + 0.25 * length(o))::int tokens, (length(text) // 4)::int plain
    from (select doc_id, text, regexp_replace(text, '[\x{4e00}-\x{9fff}]', '', 'g') o from (select doc_id, text || repeat('汉字', doc_id % 7) text from documents))""")
def token_estimate(spark, sf_dir):
    """Over texts that end in some CJK characters."""
    docs = t(spark, sf_dir, "documents").withColumn("text", F.concat("text", F.repeat(F.lit("汉字"), (F.col("doc_id") % 7).cast("int"))))
    return docs.select("doc_id", X.token_estimate("text").alias("tokens"), X.token_estimate_plain("text").alias("plain"))


@query("""
    select doc_id, case when n < 1024 then printf('%.2f B', n::double) when n < 1024*1024 then printf('%.2f KB', n / 1024.0::double) else printf('%.2f MB', n / 1048576.0::double) end size
    from (select doc_id, n_chars * 7 n from documents)""")
def human_size(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.human_size(F.col("n_chars") * 7).alias("size"))


@query("select page_id, lower(regexp_extract(url, '\\.[^./]+$')) ext from pages")
def file_extension(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", X.extension("url").alias("ext"))


@query("select doc_id, ((row_number() over (order by doc_id) - 1) // 32)::bigint batch from documents")
def batch_items(spark, sf_dir):
    from loomquery.plans.tables import row_numbers

    numbered = row_numbers(t(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"))
    return numbered.select("doc_id", X.batch_number(F.col("rn"), 32).cast("long").alias("batch"))


# Duplicates ------------------------------------------------------------------------------------------------


@query("select doc_id, md5(text) h from documents qualify row_number() over (partition by md5(text) order by doc_id) = 1")
def dedup_exact(spark, sf_dir):
    return dedup.exact(t(spark, sf_dir, "documents")).select("doc_id", F.md5("text").alias("h"))


@query("select count(*) total, count(distinct md5(text)) unique_texts, count(*) - count(distinct md5(text)) duplicates from documents")
def dedup_counts(spark, sf_dir):
    n = t(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("total"), F.count("*").alias("unique_texts"), (F.sum("n") - F.count("*")).alias("duplicates"))


_SIM = "list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e)))"


# the vectors, and for each hundredth one three that stray from it step by step
_PLANTED = """select vec_id, label, embedding::double[] e from embeddings
    union all select vec_id + 1000000 * s, label, list_transform(embedding::double[], lambda x, i: case when i = s + 1 then x + 0.9 * s else x end) from embeddings, (values (1), (2), (3)) v(s) where vec_id % 100 = 0"""
_NEAR = f"with v as ({_PLANTED}), p as (select a.vec_id id_a, b.vec_id id_b, {_SIM} similarity from v a join v b on a.vec_id < b.vec_id where {_SIM} >= 0.8)"


def _planted(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    moved = lambda s: F.transform("embedding", lambda x, i: F.when(i == s, x + 0.9 * s).otherwise(x)).alias("embedding")
    out = e
    for s in (1, 2, 3):
        out = out.unionByName(e.filter("vec_id % 100 = 0").select((F.col("vec_id") + 1_000_000 * s).alias("vec_id"), "label", moved(s)))
    return out


@query(f"{_NEAR} select id_a, id_b, round(similarity, 6) similarity from p")
def dedup_embedding_pairs(spark, sf_dir):
    return dedup.similar_pairs(_planted(spark, sf_dir), 0.8)


@query(f"""
    {_NEAR.replace("with v", "with recursive v")}, n as (select id_b id, list(id_a) earlier, row_number() over (order by id_b) i from p group by id_b),
    g(i, gone) as (select 0::bigint, []::bigint[] union all
      select n.i, case when len(list_filter(earlier, lambda x: not list_contains(gone, x))) > 0 then list_append(gone, id) else gone end from g join n on n.i = g.i + 1)
    select vec_id, label from v where not list_contains((select gone from g order by i desc limit 1), vec_id)""")
def dedup_embedding(spark, sf_dir):
    """Greedy: each vector against the earlier ones that are kept."""
    return dedup.by_embedding(_planted(spark, sf_dir), 0.8).select("vec_id", "label")


# Splitters -------------------------------------------------------------------------------------------------


@query("""
    select doc_id, (i - 1)::int line_index, l[i] line from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') l from documents), lateral (select unnest(generate_series(1, len(l))) i)""")
def split_lines(spark, sf_dir):
    return split.lines(t(spark, sf_dir, "documents"))


_SENT = "list_filter(list_transform(string_split(regexp_replace(text, '([。！？；?!.])[ \\t\\n\\x0B\\f\\r]*', '\\1' || chr(1), 'g'), chr(1)), lambda x: " + _strip("x") + "), lambda x: x <> '')"


@query(f"select doc_id, (i - 1)::int sentence_index, l[i] sentence from (select doc_id, {_SENT} l from documents), lateral (select unnest(generate_series(1, len(l))) i)")
def split_sentences(spark, sf_dir):
    return split.sentences(t(spark, sf_dir, "documents"))


@query(f"""
    select doc_id, (i - 1)::int sentence_index, l[i] sentence from
    (select doc_id, list_filter(list_transform(string_split_regex(translate(text, '.!?;', '。！？；'), '[。！？；]'), lambda x: {_strip("x")}), lambda x: x <> '') l from documents),
    lateral (select unnest(generate_series(1, len(l))) i)""")
def split_cjk_sentences(spark, sf_dir):
    """Over documents with CJK marks."""
    return split.cjk_sentences(t(spark, sf_dir, "documents").select("doc_id", F.translate("text", ".!?;", "。！？；").alias("text")))


@query(f"""
    select doc_id, g::int chunk_index, string_agg(s, chr(10) order by i) text from
    (select doc_id, i, l[i] s, (i - 1) // 2 g from (select doc_id, {_SENT} l from documents), lateral (select unnest(generate_series(1, len(l))) i)) group by doc_id, g""")
def split_fallback(spark, sf_dir):
    return split.groups_of_sentences(t(spark, sf_dir, "documents"))


_MD = "select doc_id, '# T' || doc_id || chr(10) || replace(text, '. ', '.' || chr(10) || '## S' || chr(10)) text from documents"


@query(f"""
    with l as (select doc_id, i, l[i] line from (select doc_id, string_split(text, chr(10)) l from ({_MD})), lateral (select unnest(generate_series(1, len(l))) i)),
    s as (select *, greatest(sum(regexp_matches(line, '^#{{1,6}}[ \\t]')::int) over (partition by doc_id order by i), 1) - 1 section from l),
    j as (select doc_id, section, {_strip("string_agg(line, chr(10) order by i)")} text from s group by doc_id, section)
    select doc_id, section::int section, regexp_extract(text, '^#{{1,6}}[ \\t]+([^\\n]*)', 1) header, text,
      'T' || doc_id || case when section = 0 then '' else ' > S' end path from j where text <> ''""")
def split_headers(spark, sf_dir):
    md = F.concat(F.lit("# T"), F.col("doc_id").cast("string"), F.lit("\n"), F.replace(F.col("text"), F.lit(". "), F.lit(".\n## S\n")))
    return split.headers(t(spark, sf_dir, "documents").select("doc_id", md.alias("text"))).withColumn("path", F.array_join("path", " > "))


def _split_sql(source: str, size: int, overlap: int, name: str = "x") -> str:
    """CTEs of the recursive split of ``source`` (id, text): ``name`` (id, chunk_index, total_chunks, text).

    A level for each separator. Of each open part, pieces with their separator; a fold over their lengths that gives windows as
    ranges of pieces (s: where the held window starts) and pieces that are too long, which are open for the next level.
    """
    window, none = "{'a': h.s, 'b': x.i - 1, 'open': false}", "[]::struct(a bigint, b bigint, open boolean)[]"
    held = f"list_append(h.w, {window})"
    out = [f"{name}0 as (select id, [0] ord, text, true open from ({source}) where text <> '')"]
    for k, sep in enumerate(split.SEPARATORS):
        full = f"h.s < x.i and c[x.i] - c[h.s] + x.n > {size}"
        text = "array_to_string(p[v.a : v.b], '')"
        out.append(rf"""{name}p{k} as (select id, ord, regexp_extract_all(text, '(?s:.*?(?:{sep}))|(?s:.+)') p from {name}{k} where open),
    {name}l{k} as (select *, list_transform(p, lambda q: length(q)) l, list_transform(range(0, len(p) + 1), lambda i: coalesce(list_sum(list_transform(p[1:i], lambda q: length(q))), 0)::bigint) c from {name}p{k}),
    {name}f{k} as (select *, list_reduce(list_prepend({{'i': 0::bigint, 'n': 0::bigint, 's': 1::bigint, 'w': {none}}}, list_transform(l, lambda n, i: {{'i': i::bigint, 'n': n::bigint, 's': 0::bigint, 'w': {none}}})),
      lambda h, x: {{'i': x.i, 'n': x.n,
        's': case when x.n >= {size} then x.i + 1 when {full} then list_filter(range(h.s, x.i + 1), lambda j: c[x.i] - c[j] <= least({overlap}, {size} - x.n))[1] else h.s end,
        'w': case when x.n >= {size} then list_append(case when h.s < x.i then {held} else h.w end, {{'a': x.i, 'b': x.i, 'open': true}}) when {full} then {held} else h.w end}}) h from {name}l{k}),
    {name}w{k} as (select id, ord, p, unnest(w) v, unnest(range(len(w))) pos from (select id, ord, p, case when h.s <= len(p) then list_append(h.w, {{'a': h.s, 'b': len(p)::bigint, 'open': false}}) else h.w end w from {name}f{k})),
    {name}{k + 1} as (select id, ord, text, open from {name}{k} where not open union all select id, list_append(ord, pos), {text} t, v.open from {name}w{k} where v.open or {_strip(text)} <> '')""")
    last = f"select id, ord, {_strip('text')} t from {name}{len(split.SEPARATORS)}"
    out.append(rf"""{name} as (select id, (row_number() over (partition by id order by ord) - 1)::int chunk_index, (count(*) over (partition by id))::int total_chunks, regexp_replace(t, '\n{{2,}}', chr(10), 'g') text from ({last}) where t <> '')""")
    return ",\n    ".join(out)


_FAMILY = f"""
    with {_split_sql("select doc_id id, text from documents", 1500, 150, "p")},
    {_split_sql("select {'doc_id': id, 'parent_index': chunk_index} id, text from p", 200, 20)}"""


@query(f"""
    with {_split_sql("select doc_id id, text from documents", split.SIZE, split.OVERLAP)}
    select id doc_id, chunk_index, total_chunks, text from x""")
def split_recursive(spark, sf_dir):
    return split.recursive(t(spark, sf_dir, "documents").select("doc_id", "text"))


@query(rf"""
    with d as (select doc_id, string_split(text, chr(10)) l from documents where text <> ''),
    f as (select doc_id, l, list_reduce(list_prepend({{'x': '', 'i': 0::bigint, 'n': -1::bigint, 'most': {split.SIZE}::bigint, 's': []::bigint[]}}, list_transform(l, lambda x, i: {{'x': x, 'i': i::bigint, 'n': 0::bigint, 'most': 0::bigint, 's': []::bigint[]}})),
      lambda h, y: {{'x': '', 'i': y.i, 'most': case when regexp_matches({_strip("y.x")}, '^#{{1,6}}\s+.') then {2 * split.SIZE} else h.most end,
        's': case when y.i = 1 or {_strip("y.x")} <> '' and h.n >= case when regexp_matches({_strip("y.x")}, '^#{{1,6}}\s+.') then {2 * split.SIZE} else h.most end then list_append(h.s, y.i) else h.s end,
        'n': length(y.x) + 1 + case when y.i = 1 or {_strip("y.x")} <> '' and h.n >= case when regexp_matches({_strip("y.x")}, '^#{{1,6}}\s+.') then {2 * split.SIZE} else h.most end then -1 else h.n end}}).s s from d)
    select doc_id, (k - 1)::int chunk_index, len(s)::int total_chunks, array_to_string(l[s[k] : coalesce(s[k + 1], len(l) + 1) - 1], chr(10)) text from f, lateral (select unnest(range(1, len(s) + 1)) k)""")
def split_markdown(spark, sf_dir):
    return split.markdown(t(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"""
    with {_split_sql("select doc_id id, text from documents", 1500, 150)}
    select id doc_id, chunk_index, total_chunks, text from x""")
def split_parents(spark, sf_dir):
    return split.recursive(t(spark, sf_dir, "documents").select("doc_id", "text"), 1500, 150)


@query(f"{_FAMILY} select id.doc_id doc_id, id.parent_index parent_index, chunk_index child_index, text from x")
def split_parent_child(spark, sf_dir):
    return split.parent_child(t(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "parent_index", "child_index", "text")


@query(f"{_FAMILY} select p.id doc_id, p.chunk_index parent_index, p.text parent_content, count(*) child_count from p join x on x.id.doc_id = p.id and x.id.parent_index = p.chunk_index group by all")
def parent_recovery(spark, sf_dir):
    return split.parents(split.parent_child(t(spark, sf_dir, "documents").select("doc_id", "text")))


@query("""
    with v as (select label::bigint doc_id, vec_id pos, embedding::double[] a, lead(embedding::double[]) over (partition by label order by vec_id) b from embeddings),
    d as (select doc_id, pos, case when b is not null then round(1 - list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)) + 1e-8), 6) end distance from v),
    c as (select doc_id, quantile_cont(distance, 0.95) cut, count(*) n from d group by all),
    m as (select doc_id, pos, distance, (distance >= cut and n > 2)::int brk from d join c using (doc_id))
    select doc_id, pos, distance, coalesce(sum(coalesce(brk, 0)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint chunk from m""")
def split_semantic(spark, sf_dir):
    s = t(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("pos"), "embedding")
    return split.semantic(s)


# Conversations, prompts ------------------------------------------------------------------------------------

_LAST = "select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) i from (select *, row_number() over (partition by conv_id order by turn desc) back from conversations) where back <= 5"


@query(f"select conv_id, turn, role, text, i::int i from ({_LAST})")
def history_last5(spark, sf_dir):
    return evaluate.last_turns(t(spark, sf_dir, "conversations"))


@query(f"select conv_id, string_agg('第' || i || '轮 - ' || role || '：' || text, chr(10) order by i) history from ({_LAST}) group by conv_id")
def history_format(spark, sf_dir):
    return evaluate.history(t(spark, sf_dir, "conversations"))


_PAIRS = "select conv_id, turn, text question, nt answer from (select *, lead(role) over (partition by conv_id order by turn) nr, lead(text) over (partition by conv_id order by turn) nt from conversations) where role = 'user' and nr = 'assistant'"


@query(_PAIRS)
def conversation_pairs(spark, sf_dir):
    return evaluate.conversation_samples(t(spark, sf_dir, "conversations"))


@query(f"""
    select conv_id, turn, '{rag.SYSTEM.replace("'", "''")}' || chr(10) || chr(10) || 'Documents:' || chr(10) || answer || chr(10) || chr(10) || 'Question: ' || question prompt from ({_PAIRS})""")
def qa_prompt(spark, sf_dir):
    s = evaluate.conversation_samples(t(spark, sf_dir, "conversations"))
    return s.select("conv_id", "turn", rag.qa_prompt(F.col("question"), F.col("answer")).alias("prompt"))


@query()
def rag_answer(spark, sf_dir):
    """The chain with the offline client over keyword results."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("content"))
    found = bm25.search(t(spark, sf_dir, "documents"), _bench(spark, sf_dir), 5).join(docs, "doc_id")
    return rag.answer(_bench(spark, sf_dir), found)


# Evaluation ------------------------------------------------------------------------------------------------
# a sample is a user turn and its answer, which is the ground truth too; contexts are the turns before and after them,
# in some conversations with most of the question or of the answer


def _samples(spark, sf_dir):
    by = Window.partitionBy("conv_id").orderBy("turn")
    turns = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.lag("text").over(by), F.lit("")).alias("before"), F.coalesce(F.lead("text", 2).over(by), F.lit("")).alias("after"))
    pairs = evaluate.conversation_samples(t(spark, sf_dir, "conversations"))
    part = lambda c, n, num, den, rest: F.when(F.col("conv_id") % n == rest, F.substring(c, F.lit(1), F.floor(F.length(c) * num / den).cast("int"))).otherwise("")
    first, second = F.concat("before", F.lit(" "), part("question", 3, 4, 5, 0)), F.concat("after", F.lit(" "), part("answer", 4, 2, 3, 1))
    return pairs.join(turns, ["conv_id", "turn"]).withColumn("ground_truth", F.col("answer")).withColumn("contexts", F.array(first, second)).drop("before", "after")


_S = f"""with t as (select conv_id, turn, role, text, coalesce(lag(text) over o, '') b, lead(role) over o nr, lead(text) over o nt, coalesce(lead(text, 2) over o, '') n2 from conversations window o as (partition by conv_id order by turn)),
    p as (select conv_id, turn, role, text, nr, nt, b || ' ' || case when conv_id % 3 = 0 then substring(text, 1, length(text) * 4 // 5) else '' end b,
      n2 || ' ' || case when conv_id % 4 = 1 then substring(nt, 1, length(nt) * 2 // 3) else '' end n2 from t),
    s as (select conv_id, turn, {_set("text")} q, {_set("nt")} a, {_set("b")} c1, {_set("n2")} c2, {_set("b || ' ' || n2")} c, nt answer, text question from p where role = 'user' and nr = 'assistant')"""


def _ratio(a: str, b: str, factor: str = "1.0") -> str:
    return f"case when len({a}) = 0 then 0.0 else least(1.0, len(list_intersect({a}, {b})) / greatest(len({a}), 1) * {factor}) end"


def _metric_query(name: str, sql: str):
    def run(spark, sf_dir):
        return evaluate.evaluate(_samples(spark, sf_dir), [name]).select("conv_id", "turn", F.col(name).alias("score"))

    run.__name__ = f"eval_{name}"
    query(f"{_S} select conv_id, turn, round({sql}, 6)::double score from s")(run)


_SENTS = rf"list_filter(list_transform(string_split_regex(answer, '[。！？.!?]+'), lambda x: {_strip('x')}), lambda x: x <> '')"
_METRICS = {
    "faithfulness": _ratio("a", "c", "1.5"),
    "answer_relevancy": _ratio("q", "a", "2.0"),
    "context_recall": _ratio("a", "c"),
    "context_precision": "(case when len(q) = 0 then 0.0 else (select case when count(*) = 0 then 0.0 else least(1.0, sum(r / (i + 1)) / count(*)) end from (select 0 i, least(1.0, len(list_intersect(q, c1)) / greatest(len(q), 1)) r union all select 1, least(1.0, len(list_intersect(q, c2)) / greatest(len(q), 1))) where r > 0.5) end)",
    "hit_rate": "(len(list_intersect(a, c1)) >= 0.5 * len(a) or len(list_intersect(a, c2)) >= 0.5 * len(a))::int",
    "sentence_faithfulness": f"(select case when len(l) = 0 then 0.0 else len(list_filter(l, lambda x: len(list_intersect({_set('x')}, c)) / greatest(len({_set('x')}), 1) > 0.3)) / len(l) end from (select {_SENTS} l))",
    "rank_precision": "(select case when count(*) = 0 then 0.0 else least(1.0, sum(1.0 / (i + 1)) / count(*) * 2) end from (select 0 i, len(list_intersect(q, c1)) n union all select 1, len(list_intersect(q, c2))) where n > 0)",
}
for _name, _sql in _METRICS.items():
    _metric_query(_name, _sql)

_LONG = f"{_S} " + " union all ".join(f"select conv_id, turn, '{n}' metric_name, round({q}, 6)::double score from s" for n, q in _METRICS.items())


def _long(spark, sf_dir):
    return evaluate.long_form(evaluate.evaluate(_samples(spark, sf_dir)), ["conv_id", "turn"], list(M.REGISTRY))


@query(f"select metric_name, round(avg(score), 6) mean, round(stddev_pop(score), 6) std, count(*) n from ({_LONG}) group by all")
def eval_summary(spark, sf_dir):
    return evaluate.distribution(_long(spark, sf_dir)).select("metric_name", "mean", "std", "n")


@query(f"""
    select metric_name, round(avg(score), 6) mean, round(stddev_pop(score), 6) std, min(score) "min", max(score) "max", round(quantile_cont(score, 0.25), 6) p25,
    round(quantile_cont(score, 0.5), 6) p50, round(quantile_cont(score, 0.75), 6) p75, count(*) n from ({_LONG}) group by all""")
def eval_distribution(spark, sf_dir):
    return evaluate.distribution(_long(spark, sf_dir))


@query(f"""
    with m as (select metric_name, avg(score) mean from ({_LONG}) group by all)
    select round(sum(mean * w) / sum(w), 6) overall from m join (values ('faithfulness', 0.30::double), ('answer_relevancy', 0.30), ('context_recall', 0.25), ('context_precision', 0.15)) v(metric_name, w) using (metric_name)""")
def eval_overall_weighted(spark, sf_dir):
    return evaluate.overall(_long(spark, sf_dir), evaluate.WEIGHTS)


@query(f"select round(avg(mean), 6) overall from (select metric_name, avg(score) mean from ({_LONG}) group by all)")
def eval_overall(spark, sf_dir):
    return evaluate.overall(_long(spark, sf_dir))


_CONFIGS = [("narrow", 3, 0.5), ("wide", 10, 0.0), ("strict", 5, 0.9)]


@query(f"""
    with k as ({_KEY}), c as (select * from (values {", ".join(f"('{n}', {k}, {s}::double)" for n, k, s in _CONFIGS)}) v(config, top_k, threshold))
    select config, round(avg(score), 6) mean, count(*) n from k join c on k.rank <= c.top_k and k.score >= c.threshold group by config""")
def eval_compare_configs(spark, sf_dir):
    configs = spark.createDataFrame(_CONFIGS, "config string, top_k int, threshold double")
    long = lambda df: df.select("config", F.lit("score").alias("metric_name"), "score")
    return evaluate.compare(_keywords(spark, sf_dir), configs, long).select("config", "mean", "n")


@query(f"pivot (select conv_id, turn, metric_name, score from ({_LONG})) on metric_name in ({', '.join(repr(m) for m in _METRICS)}) using first(score) group by conv_id, turn")
def eval_pivot(spark, sf_dir):
    return evaluate.wide_form(_long(spark, sf_dir), ["conv_id", "turn"], list(M.REGISTRY))


@query("""
    with b as (select (row_number() over (order by doc_id) - 1) // greatest(1, (select count(*) from documents) // 7) bucket, doc_id, text from documents)
    select bucket::bigint bucket, md5(substring(string_agg(text, chr(10) order by doc_id), 1, 8000)) context, count(*)::int n_chunks from b where bucket < 7 group by bucket""")
def testset_buckets(spark, sf_dir):
    return evaluate.testset_buckets(t(spark, sf_dir, "documents"), 7).withColumn("context", F.md5("context"))


# Knowledge base --------------------------------------------------------------------------------------------


@query("""
    select count(distinct doc_id) document_count, count(*)::bigint total_chunks, count(distinct source) source_count, (select string_agg(s, ',' order by s) from (select distinct source s from documents)) sources from documents""")
def kb_stats(spark, sf_dir):
    return K.stats(t(spark, sf_dir, "documents").select("doc_id", "source"))


def _collection(spark, sf_dir) -> K.Collection:
    """All documents as a collection, their source, language and length as metadata."""
    made = K.Collection(spark, own_dir(spark), f"kb-{uuid.uuid4().hex}", columns={"lang": "string", "source": "string", "n_chars": "double"})
    made.upsert(_records(t(spark, sf_dir, "documents")))
    return made


def _records(docs):
    meta = F.create_map(*[x for k in ("lang", "source", "n_chars") for x in (F.lit(k), F.col(k).cast("string"))])
    return docs.select(F.lpad(F.col("doc_id").cast("string"), 15, "0").alias("id"), F.col("text").alias("document"), meta.alias("metadata"))


def _meta(records, *keys, **types):
    each = [F.try_element_at("metadata", F.lit(k)).cast(types.get(k, "string")).alias(k) for k in keys]
    return records.select(F.col("id").cast("long").alias("doc_id"), *each)


@query("select doc_id, source from documents where source <> 'src1' or source is null")
def kb_delete_by_source(spark, sf_dir):
    kb = _collection(spark, sf_dir)
    K.KnowledgeBase(kb).delete_by_source("src1")
    return _meta(kb.read(), "source")


@query("select doc_id, case when doc_id % 10 = 0 then 'new' else source end source, md5(text) text_md5 from documents")
def kb_upsert(spark, sf_dir):
    kb = _collection(spark, sf_dir)
    kb.upsert(_records(t(spark, sf_dir, "documents").filter("doc_id % 10 = 0").withColumn("source", F.lit("new"))))
    texts = kb.read().select(F.col("id").cast("long").alias("doc_id"), F.md5("document").alias("text_md5"))
    return _meta(kb.read(), "source").join(texts, "doc_id")


@query("select doc_id, lang, source from documents where lang in ('de', 'fr') and n_chars >= 500 and (source = 'src1' or source = 'src2')")
def kb_filter(spark, sf_dir):
    wanted = {"lang": ["de", "fr"], "n_chars": {"$gte": 500}, "$or": [{"source": "src1"}, {"source": {"$eq": "src2"}}]}
    return _meta(_collection(spark, sf_dir).read(filters=wanted), "lang", "source")


@query("select doc_id, lang from documents where n_chars >= 500 and n_chars < 2000 and lang in ('en', '7')")
def kb_filter_mixed(spark, sf_dir):
    """Typed columns where one key's texts are numbers for some records only, and other keys are missing."""
    docs = t(spark, sf_dir, "documents")
    kb = K.Collection(spark, own_dir(spark), f"kb-{uuid.uuid4().hex}", columns={"size": "double"})
    size = F.when(F.col("n_chars") < 500, F.lit("few")).otherwise(F.col("n_chars").cast("string"))
    kb.add(_records(docs).join(docs.select(F.lpad(F.col("doc_id").cast("string"), 15, "0").alias("id"), size.alias("size")), "id").select("id", "document", F.map_concat("metadata", F.create_map(F.lit("size"), F.col("size"))).alias("metadata")))
    return _meta(kb.read(filters={"$and": [{"size": {"$lt": 2000}}, {"lang": ["en", 7]}]}), "lang")


@query("select doc_id, case when lang = 'en' then source else 'second' end source, count(*) over ()::bigint total from documents")
def kb_add(spark, sf_dir):
    """An id that is there already stays as it is."""
    docs = t(spark, sf_dir, "documents")
    kb = K.Collection(spark, own_dir(spark), f"kb-{uuid.uuid4().hex}")
    total = kb.add(_records(docs.filter("lang = 'en'"))) + kb.add(_records(docs.withColumn("source", F.lit("second"))))
    return _meta(kb.read(), "source").withColumn("total", F.lit(total).cast("long"))


@query("select doc_id, case when lang = 'de' then 'changed' else md5(text) end text_md5 from documents")
def kb_update(spark, sf_dir):
    """Records that exist are replaced, others are ignored."""
    docs, kb = t(spark, sf_dir, "documents"), _collection(spark, sf_dir)
    kb.update(_records(docs.filter("lang = 'de'").withColumn("text", F.lit(None).cast("string"))))
    kb.update(_records(docs.withColumn("doc_id", -1 - F.col("doc_id"))))
    return kb.read().select(F.col("id").cast("long").alias("doc_id"), F.coalesce(F.md5("document"), F.lit("changed")).alias("text_md5"))


@query("""
    select v.version, count(*) n from documents, (values (0), (1), (2), (3)) v(version) where v.version = 0 or (source <> 'src1' or source is null) and (v.version = 1 or lang <> 'de' or lang is null) group by all""")
def kb_versions(spark, sf_dir):
    """What older versions held, and that folding a collection into one folder changes nothing."""
    kb = _collection(spark, sf_dir)
    kb.delete(filters={"source": "src1"})
    kb.delete(filters={"lang": "de"})
    kb.compact()
    parts = [kb.read(v).agg(F.lit(v).alias("version"), F.count("*").alias("n")) for v in kb.versions()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("select doc_id, case when source is null then 'lang,n_chars' else 'lang,n_chars,source' end keys from documents")
def kb_stored_keys(spark, sf_dir):
    """Keys without a value, and those that are never stored, go."""
    kb = K.Collection(spark, own_dir(spark), f"kb-{uuid.uuid4().hex}")
    more = F.map_concat("metadata", F.create_map(*[F.lit(x) for k in K.NEVER_STORED for x in (k, "1")]))
    kb.upsert(_records(t(spark, sf_dir, "documents")).withColumn("metadata", more))
    return kb.read().select(F.col("id").cast("long").alias("doc_id"), F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("keys"))


@query(f"""
    with r as ({_knn_sql(where="label >= 3 and label < 9", k=5)}) select query_id, vec_id, distance, round(1 - distance, 6) score, rank from r where round(1 - distance, 6) >= 0.4""")
def kb_search(spark, sf_dir):
    """A collection's own search, with a filter on typed metadata and a threshold."""
    e = t(spark, sf_dir, "embeddings")
    kb = K.Collection(spark, own_dir(spark), f"kb-{uuid.uuid4().hex}", columns={"label": "double"})
    meta = F.create_map(F.lit("label"), F.col("label").cast("string"))
    kb.add(e.select(F.lpad(F.col("vec_id").cast("string"), 15, "0").alias("id"), F.lit("").alias("document"), "embedding", meta.alias("metadata")))
    found = kb.search(_vq(spark, sf_dir), 5, {"label": {"$gte": 3, "$lt": 9}}, 0.4)
    return found.select("query_id", F.col("id").cast("long").alias("vec_id"), "distance", "score", "rank")


@query("select doc_id, 'insert' change, md5(text) text_md5, 0 changed_again from documents")
def kb_follow_stream(spark, sf_dir):
    """A collection kept up to date by a stream of the documents; a second stream with the same texts changes nothing."""
    from loomquery.streaming import ingest

    kb, root = K.Collection(spark, own_dir(spark), f"kb-{uuid.uuid4().hex}"), f"{own_dir(spark)}/follow-{uuid.uuid4().hex}"
    schema = t(spark, sf_dir, "documents").schema
    # by a pattern, which the stream takes for one file as for a folder of them
    read = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    stream = read.select(F.col("doc_id").cast("string").alias("id"), "text", F.lit("2024-01-01").cast("timestamp").alias("arrived"))
    before = spark.conf.get(ingest._STORE, None)
    try:
        for _ in range(2):
            ingest.follow(stream, kb, root).awaitTermination()
    finally:
        spark.conf.set(ingest._STORE, before) if before else spark.conf.unset(ingest._STORE)
    change = F.try_element_at("metadata", F.lit("change")).alias("change")
    return kb.read().select(F.col("id").cast("long").alias("doc_id"), change, F.md5("document").alias("text_md5"), F.lit(len(kb.versions()) - 1).alias("changed_again"))


@query("select text question, '' answer, md5(text) ground_truth_context, item_id::varchar item from benchmark")
def testset_files(spark, sf_dir):
    """A test set written as lines and read back; keys that are missing get defaults."""
    path = f"{own_dir(spark)}/testset-{uuid.uuid4().hex}"
    meta = F.create_map(F.lit("item"), F.col("item_id").cast("string"))
    sinks.testset(t(spark, sf_dir, "benchmark").select(F.col("text").alias("question"), F.md5("text").alias("ground_truth_context"), meta.alias("metadata")), path)
    return loaders.testset(spark, path).select("question", "answer", "ground_truth_context", F.try_element_at("metadata", F.lit("item")).alias("item"))


@query("select o_orderkey, o_orderstatus, o_totalprice::varchar o_totalprice from orders")
def csv_export(spark, sf_dir):
    path = f"{own_dir(spark)}/export-{uuid.uuid4().hex}"
    sinks.csv(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("string")), path)
    return spark.read.option("header", True).schema("o_orderkey long, o_orderstatus string, o_totalprice string").csv(path)


@query("select doc_id, source, 1.0::double score from documents order by doc_id limit 1000")
def kb_scan(spark, sf_dir):
    """The scan's own limit of 1000 records is the feature."""
    found = _collection(spark, sf_dir).scan()
    return _meta(found, "source").withColumn("score", F.lit(1.0).cast("double"))


@query("select count(*) n from documents")
def kb_count(spark, sf_dir):
    return spark.createDataFrame([(_collection(spark, sf_dir).count(),)], "n long")


@query("""
    select d.doc_id, l.quality, l.toxic, d.source from documents d join labels l using (doc_id) where l.quality = 1 and l.toxic <> 1""")
def kb_label_filter(spark, sf_dir):
    both = t(spark, sf_dir, "documents").select("doc_id", "source").join(t(spark, sf_dir, "labels"), "doc_id")
    return both.filter(K.where({"quality": 1, "toxic": {"$ne": 1}}, F.col)).select("doc_id", "quality", "toxic", "source")


@query("select count(distinct source) documents, count(*) chunks from documents")
def ingest_counts(spark, sf_dir):
    from loomquery.plans.pipeline import counts

    return counts(t(spark, sf_dir, "documents"))


# Query rewriting -------------------------------------------------------------------------------------------


_SHORT = [(-1, "short statement"), (-2, "what is it?"), (-3, "这是什么或那是什么"), (-4, "a statement of over thirty characters, which is specific"), (-5, "这是谁呢")]
_ASKED = "select item_id query_id, case item_id % 4 when 0 then text when 1 then text || '?' when 2 then text || '吗' else text || '呢或' end query from benchmark union all select * from (values " + ", ".join(map(str, _SHORT)) + ")"


def _asked(spark, sf_dir):
    """Whole benchmark texts as statements, questions and alternatives, and a few short ones."""
    kind, text = F.col("item_id") % 4, F.col("text")
    query = F.when(kind == 0, text).when(kind == 1, F.concat(text, F.lit("?"))).when(kind == 2, F.concat(text, F.lit("吗"))).otherwise(F.concat(text, F.lit("呢或")))
    return t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), query.alias("query")).unionByName(spark.createDataFrame(_SHORT, "query_id long, query string"))


@query(f"""
    select query_id, case when regexp_matches(query, '[?？]|吗|呢|怎么|如何|为什么|什么|哪|是不是|谁|多少|是否') then case when length(query) > 20 or contains(query, '或') then 'decomposition' else 'expansion' end
    when length(query) > 30 then 'specific' else 'expansion' end strategy from ({_ASKED})""")
def rewrite_strategy(spark, sf_dir):
    return _asked(spark, sf_dir).select("query_id", rewrite.strategy(F.col("query")).alias("strategy"))


_LINE = _strip(r"regexp_replace(" + _strip("x") + r", '^[0-9.\-*、。,)）]+', '')")


@query(rf"select doc_id, array_to_string(list_filter(list_transform(string_split({_strip("'12. ' || replace(text, '. ', chr(10) || '- ')")}, chr(10)), lambda x: {_LINE}), lambda x: length(x) > 2), '|') queries from documents")
def parse_queries(spark, sf_dir):
    """Documents as numbered and bulleted replies."""
    reply = F.concat(F.lit("12. "), F.replace(F.col("text"), F.lit(". "), F.lit("\n- ")))
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(X.parse_lines(reply), "|").alias("queries"))


@query(f"""
    with p as (select doc_id, doc_id % 5 kind, lang || ' asks' question, text answer from documents),
    r as (select *, string_split(text, '?') l from (select doc_id, kind, question, answer, {_strip("answer")} text from p))
    select doc_id, case when kind < 2 then question when kind = 2 then question || '?' when kind = 3 then '' when len(l) > 1 then {_strip("replace(replace(l[1], '问题:', ''), 'Q:', '')")} || '?' end question,
      case when kind < 2 then answer when kind = 2 then {_strip("replace(string_split(string_split(' A: ' || answer, '?')[1], '答案:')[-1], 'A:', '')")} when kind = 3 then answer
        when len(l) > 1 then {_strip("replace(string_split(l[2], '答案:')[-1], 'A:', '')")} end answer from r""")
def parse_llm_json(spark, sf_dir):
    """Documents as replies: JSON, JSON in a fence, a labelled question, JSON without a question, plain text."""
    kind, asks = F.col("doc_id") % 5, F.concat("lang", F.lit(" asks"))
    whole = F.to_json(F.struct(asks.alias("question"), F.col("text").alias("answer")))
    reply = F.when(kind == 0, whole).when(kind == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Q: "), asks, F.lit("? A: "), "text"))
    reply = reply.when(kind == 3, F.to_json(F.struct(F.col("text").alias("answer")))).otherwise(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", X.parse_answer(reply).alias("x")).select("doc_id", "x.question", "x.answer")


@query(r"""
    with p as (select item_id query_id, text, list_filter(string_split_regex(text, '[^\p{L}\p{N}]+'), lambda x: length(x) > 1 and lower(x) not in ('一个','没有','自己','the','a','an','is','are','of','to','in','and','or')) k from benchmark)
    select query_id, case when len(k) > 0 then array_to_string(k, ' ') else text end keywords from p""")
def keyword_fallback(spark, sf_dir):
    return t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(rewrite.keywords(F.col("text")), " ").alias("keywords"))


class Parrot:
    """A client that repeats the query after the first word of its task."""

    def invoke(self, prompt: str) -> str:
        task, _, query = prompt.partition("\n\n")
        return f"1. {task.split()[0]} {' '.join(query.split(chr(10)))}"


@query(f"""
    select distinct query_id, {_strip("v || replace(query, chr(10), ' ')")} variant from ({_ASKED}), (values ('Write '), ('Split ')) w(v)
    union select query_id, query from ({_ASKED})""")
def query_variants(spark, sf_dir):
    """Every query by three strategies and a client; equal variants count once."""
    return rewrite.variants(rewrite.multi_strategy(_asked(spark, sf_dir), Parrot))


# Tables as documents, events -------------------------------------------------------------------------------


@query("""
    select c_custkey::varchar id, array_to_string(list_filter([case when c_name <> '' then 'c_name: ' || c_name end, case when note <> '' then 'note: ' || note end], lambda x: x is not null), chr(10)) text
    from (select c_custkey, c_name, case when c_custkey % 3 = 0 then '' else c_mktsegment || ', "' || chr(10) || c_nationkey || '"' end note from customer)""")
def csv_documents(spark, sf_dir):
    """Customers written as CSV, with quotes, line ends and empty cells, and read by the loader."""
    note = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat("c_mktsegment", F.lit(', "\n'), "c_nationkey", F.lit('"')))
    path = f"{own_dir(spark)}/customers-{uuid.uuid4().hex}"
    t(spark, sf_dir, "customer").select("c_custkey", "c_name", note.alias("note")).write.options(header=True, quote='"', escape='"', quoteAll=True).csv(path)
    read = loaders.csv(spark, path, ["c_name", "note"], metadata_columns=["c_custkey"])
    return read.select(F.col("metadata")["c_custkey"].alias("id"), "text")


@query("select doc_id, length(text) - length(replace(text, chr(10), '')) + 1 line_count from documents")
def code_line_count(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("line_count"))


@query("select time_bucket(interval '5 minutes', ts) window_start, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def events_windowed(spark, sf_dir):
    from loomquery.streaming.ingest import windowed

    out = windowed(t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select source, doc_id, n_chars, rank::int rank from (select source, doc_id, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) rank from documents) where rank <= 3")
def top_by_source(spark, sf_dir):
    return top(t(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), 3, ["source"], F.col("n_chars").desc(), F.col("doc_id"))


@query("select doc_id, count(*) over (partition by source) source_size from documents")
def chunk_totals(spark, sf_dir):
    return with_group_size(t(spark, sf_dir, "documents").select("doc_id", "source"), "source", "source_size").select("doc_id", "source_size")
