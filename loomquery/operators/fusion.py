"""Rank fusion, hybrid retrieval and reranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomquery.functions import vector as V
from loomquery.operators import bm25, knn
from loomquery.plans.tables import save, top

RRF_K = 60


def normal_weights(semantic: float, keyword: float) -> tuple[float, float]:
    total = semantic + keyword
    return (semantic / total, keyword / total) if total > 0 else (0.5, 0.5)


def over_fetch(k: int) -> int:
    """How many results each leg of a hybrid search fetches."""
    return max(2 * k, 10)


def rrf(legs: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K, limit: int | None = None, content_col: str | None = None, lone_scores: bool = False) -> DataFrame:
    """Weighted reciprocal ranks: legs of (query_id, doc_id, rank[, score, content]) to (query_id, doc_id, score, rank).

    Legs are stacked and summed by document, so no outer join is needed and each leg is planned once. With
    ``content_col`` the best document of each content stays. With ``lone_scores`` a query that one leg alone
    answers keeps that leg's scores.
    """
    weights, both = weights or {}, None
    cols = ["query_id", "doc_id", "rank", *([content_col] if content_col else [])]
    for i, (name, leg) in enumerate(legs.items()):
        own = [F.col("score").cast("double").alias("own"), F.lit(1 << i).alias("leg")] if lone_scores else []
        part = leg.select(*cols, F.lit(float(weights.get(name, 1.0))).alias("w"), *own)
        both = part if both is None else both.unionByName(part)
    more = [F.max(content_col).alias(content_col)] if content_col else []
    more += [F.max("own").alias("own"), F.bit_or("leg").alias("leg")] if lone_scores else []
    fused = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") / (k + F.col("rank"))), 8).alias("score"), *more)
    order = [F.col("score").desc(), F.col("doc_id")]
    if content_col:
        fused = fused.withColumn("n", F.row_number().over(Window.partitionBy("query_id", content_col).orderBy(*order))).filter("n = 1").drop("n")
    if lone_scores:
        fused = fused.withColumn("leg", F.bit_or("leg").over(Window.partitionBy("query_id")))
    best = top(fused, limit or 2**31 - 1, ["query_id"], *order)
    return best.withColumn("score", F.when(F.bit_count("leg") == 1, F.col("own")).otherwise(F.col("score"))).drop("own", "leg") if lone_scores else best


def hybrid(semantic: DataFrame | None, keyword: DataFrame | None, k: int = 5, weights: tuple[float, float] = (0.7, 0.3), rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Fuse two legs to 2k, rerank if asked, cut to k. A single leg is passed on as it is, in its own order: its scores may be rounded.

    A leg without rows for a query leaves that query to the other leg alone, score included.
    """
    legs = {n: leg for n, leg in (("semantic", semantic), ("keyword", keyword)) if leg is not None}
    if not legs:
        raise ValueError("a hybrid search needs a leg")
    if len(legs) == 1:
        fused = next(iter(legs.values())).select("query_id", "doc_id", "score", "rank")
        if not rerank:
            return top_k(fused, k)
    else:
        fused = rrf(legs, {"semantic": weights[0], "keyword": weights[1]}, limit=2 * k, lone_scores=True)
    ranked = rerank(fused) if rerank else fused
    return top(ranked.drop("rank"), k, ["query_id"], F.col("score").desc(), F.col("doc_id"))


def keyword_leg(docs: DataFrame, **options) -> Callable[[DataFrame, int], DataFrame]:
    """Text queries (query_id, query) to keyword results over documents (doc_id, text)."""
    return lambda queries, k: bm25.search(docs, queries.select("query_id", "query"), k, **options).select("query_id", "doc_id", "score", "rank")


def semantic_leg(vectors: DataFrame, embed: Callable[[Column], Column], id_col: str = "doc_id", metric: str = "cosine", where: Column | None = None) -> Callable[[DataFrame, int], DataFrame]:
    """Text queries (query_id, query) to the nearest of vectors (id, embedding)."""

    def leg(queries: DataFrame, k: int) -> DataFrame:
        asked = save(queries.select("query_id", embed(F.col("query")).alias("query")), "queries")
        found = knn.search(vectors, asked, k, metric, where, id_col)
        return found.select("query_id", F.col(id_col).alias("doc_id"), V.score(F.col("distance"), metric, clamp=True).alias("score"), "rank")

    return leg


@dataclass
class Hybrid:
    """A hybrid search that is set up once: functions from (queries, k) to legs, weights, and a reranker with a switch."""

    semantic: Callable[[DataFrame, int], DataFrame] | None
    keyword: Callable[[DataFrame, int], DataFrame] | None
    weights: tuple[float, float] = (0.7, 0.3)
    reranker: Callable[[DataFrame], DataFrame] | None = None
    rerank: bool = True

    def set_weights(self, semantic: float, keyword: float) -> None:
        self.weights = normal_weights(semantic, keyword)

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        legs = [leg(queries, over_fetch(k)) if leg else None for leg in (self.semantic, self.keyword)]
        return hybrid(*legs, k, self.weights, self.reranker if self.rerank else None)

    def stats(self) -> dict:
        return {"semantic": self.semantic is not None, "keyword": self.keyword is not None, "weights": self.weights, "rerank": self.rerank and self.reranker is not None}


def simple_rerank(results: DataFrame, k: int | None = None, normalize: bool = True) -> DataFrame:
    """Scores spread over 0 to 1 within each query (unless all are equal), sorted and cut."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    score = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.col("score")) if normalize else F.col("score")
    out = results.withColumn("s", F.round(score, 6)).drop("rank", "score").withColumnRenamed("s", "score")
    return top(out, k or 2**31 - 1, ["query_id"], F.col("score").desc(), F.col("doc_id"))


def overlap_score(query: Column, text: Column) -> Column:
    """The default reranker's score: the share of the query's words in the text."""
    from loomquery.functions.metrics import tokens

    q = tokens(query)
    return F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1))


def cross_encoder(load: Callable[[], Callable[[list[str], list[str]], Sequence]], batch: int = 8, length: int = 512) -> Callable[[Column, Column], Column]:
    """A pair score from a model: ``load`` makes, once a Python worker, a function of queries and texts to logits.

    Pairs go in batches of ``batch``, cut to ``length`` words. One logit a pair becomes its sigmoid, two or
    more the second one's softmax.
    """
    made: list = []

    @F.pandas_udf(T.DoubleType())
    def score(queries: pd.Series, texts: pd.Series) -> pd.Series:
        if not made:
            made.append(load())
        cut = lambda s: [" ".join((x or "").split()[:length]) for x in s]
        q, t, out = cut(queries), cut(texts), []
        for i in range(0, len(q), batch):
            z = np.asarray(made[0](q[i : i + batch], t[i : i + batch]), dtype=np.float64).reshape(len(q[i : i + batch]), -1)
            if z.shape[1] == 1:
                out += (1 / (1 + np.exp(-z[:, 0]))).tolist()
            else:
                e = np.exp(z - z.max(axis=1, keepdims=True))
                out += (e[:, 1] / e.sum(axis=1)).tolist()
        return pd.Series(out, dtype="float64")

    return score


def as_results(found: DataFrame, id_col: str = "doc_id", content_col: str = "text") -> DataFrame:
    """Any rows with an id and a text as results: (query_id, doc_id, content, score, source, rank), with defaults for what is missing."""
    have = set(found.columns)
    part = lambda name, kind, default: (F.col(name) if name in have else F.lit(default)).cast(kind).alias(name)
    content = F.col("content" if "content" in have else content_col).cast("string").alias("content")
    rows = found.select(part("query_id", "long", 0), F.col(id_col).alias("doc_id"), content, part("score", "double", 0.0), part("source", "string", None), *(["rank"] if "rank" in have else []))
    return rows if "rank" in have else top(rows, 2**31 - 1, ["query_id"], F.col("score").desc(), F.col("doc_id"))


def rerank(results: DataFrame, score: Callable[[Column, Column], Column] = overlap_score, k: int | None = None) -> DataFrame:
    """Results (query_id, doc_id, query, content) scored again by a pair function: words in common, a cross-encoder or one's own."""
    out = results.withColumn("score", F.round(score(F.col("query"), F.col("content")), 6)).drop("rank")
    return top(out, k or 2**31 - 1, ["query_id"], F.col("score").desc(), F.col("doc_id"))


def filter_results(results: DataFrame, min_score: float | None = None, max_score: float | None = None, source: str | None = None) -> DataFrame:
    for on, cond in ((min_score, lambda: F.col("score") >= min_score), (max_score, lambda: F.col("score") <= max_score), (source, lambda: F.col("source") == source)):
        results = results.filter(cond()) if on is not None else results
    return results


def top_k(results: DataFrame, k: int) -> DataFrame:
    return results.filter(F.col("rank") <= k)


def context(results: DataFrame, content: Column, separator: str = "\n\n") -> DataFrame:
    """(query_id, context): contents joined in order of rank."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("rank"), content.alias("c"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda x: x["c"]), separator).alias("context"))
