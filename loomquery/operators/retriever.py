"""One contract for all retrievers: add documents, retrieve for a batch of queries, and say what happened.

A retriever gives ``Retrieved``: the results (query_id, doc_id, content, score, rank) as a plan, notes of how they were found, and an
error instead of an exception, so that a pipeline of retrievers goes on with what the others found. Each runs on what is
stored: a segmented keyword index, a collection with its vector index, or several retrievers fused by rank.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.operators.segments import SegmentedIndex
from loomquery.plans.tables import save, sized, top
from loomquery.sources.collections import Collection

RESULT = "query_id long, doc_id string, content string, score double, rank int"


@dataclass
class Retrieved:
    results: DataFrame
    notes: dict = field(default_factory=dict)
    error: str | None = None

    @property
    def failed(self) -> bool:
        return self.error is not None


class Retriever:
    """``find`` is what a retriever of one's own defines; ``retrieve`` checks, runs it and notes the outcome."""

    name = "retriever"

    def __init__(self, spark: SparkSession, k: int = 5, threshold: float | None = None):
        self.spark, self.k, self.threshold = spark, k, threshold

    def add(self, docs: DataFrame) -> int:
        """Take documents (doc_id, text) in; how many were added."""
        raise NotImplementedError

    def delete(self, ids: DataFrame) -> int:
        raise NotImplementedError

    def find(self, queries: DataFrame, k: int, filters: dict | None) -> DataFrame:
        """(query_id, doc_id, content, score): up to ``k`` of each query (query_id, query)."""
        raise NotImplementedError

    def stats(self) -> dict:
        return {"retriever": self.name, "k": self.k, "threshold": self.threshold}

    def retrieve(self, queries: DataFrame, k: int | None = None, filters: dict | None = None, threshold: float | None = None) -> Retrieved:
        """The best of each query, computed and saved, so that what fails fails here and is told."""
        k, threshold = k or self.k, self.threshold if threshold is None else threshold
        notes, began = {**self.stats(), "k": k, "threshold": threshold, "filters": filters}, time.time()
        try:
            if missing := {"query_id", "query"} - set(queries.columns):
                raise ValueError(f"queries lack {sorted(missing)}")
            found = self.find(queries, k, filters).select("query_id", F.col("doc_id").cast("string").alias("doc_id"), "content", F.col("score").cast("double").alias("score"))
            found = found if threshold is None else found.filter(F.col("score") >= threshold)
            kept = save(top(found, k, ["query_id"], F.col("score").desc(), F.col("doc_id")), "retrieved")
            counts = kept.agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("q")).first()
            notes |= {"results": counts["n"], "queries_with_results": counts["q"], "seconds": round(time.time() - began, 3)}
            return Retrieved(kept, notes)
        except Exception as e:  # noqa: BLE001  told in the result
            return Retrieved(self.spark.createDataFrame([], RESULT), notes | {"results": 0, "seconds": round(time.time() - began, 3)}, f"{type(e).__name__}: {str(e)[:500]}")


class Keyword(Retriever):
    """BM25 over a segmented index; contents come from the documents that ``contents`` (doc_id, text) names."""

    name = "keyword"

    def __init__(self, index: SegmentedIndex, contents: DataFrame, k: int = 5, threshold: float | None = None, idf_kind: str = "okapi"):
        super().__init__(index.spark, k, threshold)
        self.index, self.contents, self.idf_kind = index, contents, idf_kind

    def add(self, docs: DataFrame) -> int:
        own = docs.select("doc_id", "text")
        self.contents = self.contents.join(own.select("doc_id"), "doc_id", "left_anti").unionByName(own)
        return self.index.add(own)

    def delete(self, ids: DataFrame) -> int:
        return self.index.delete(ids)

    def find(self, queries: DataFrame, k: int, filters: dict | None) -> DataFrame:
        if filters:
            raise ValueError("a keyword index holds no metadata to filter by")
        found = save(self.index.search(queries, k, self.idf_kind), "found")
        return self.contents.select("doc_id", F.col("text").alias("content")).join(sized(found), "doc_id")

    def stats(self) -> dict:
        n, length = self.index.totals()
        return {**super().stats(), "documents": n, "mean_length": round(length, 3), "segments": len(self.index.about()["segments"])}


class Semantic(Retriever):
    """Nearest records of a collection that embeds; by its vector index where it has one and there is no filter."""

    name = "semantic"

    def __init__(self, collection: Collection, k: int = 5, threshold: float | None = None, approximate: bool = True):
        super().__init__(collection.spark, k, threshold)
        self.collection, self.approximate = collection, approximate

    def add(self, docs: DataFrame) -> int:
        return self.collection.add(docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document"), *[c for c in docs.columns if c == "metadata"]))

    def delete(self, ids: DataFrame) -> int:
        before = self.collection.count()
        self.collection.remove(ids.select(F.col("doc_id").cast("string").alias("id")))
        return before - self.collection.count()

    def find(self, queries: DataFrame, k: int, filters: dict | None) -> DataFrame:
        asked = queries.withColumnRenamed("query", "text") if "text" not in queries.columns else queries
        found = save(self.collection.search(asked, k, filters, approximate=self.approximate), "found")
        texts = self.collection.read().select("id", F.col("document").alias("content"))
        return texts.join(sized(found), "id").withColumnRenamed("id", "doc_id")

    def stats(self) -> dict:
        return {**super().stats(), "documents": self.collection.count(), "indexed": self.collection._indexed() is not None}


class Fused(Retriever):
    """Several retrievers by reciprocal ranks; one that fails is noted and left out, and only if all fail is there an error."""

    name = "fused"

    def __init__(self, legs: Sequence[Retriever], weights: Sequence[float] | None = None, k: int = 5, threshold: float | None = None, constant: int = 60):
        super().__init__(legs[0].spark, k, threshold)
        self.legs, self.constant, self.told = list(legs), constant, []
        self.weights = list(weights or [1 / len(self.legs)] * len(self.legs))

    def add(self, docs: DataFrame) -> int:
        return max(leg.add(docs) for leg in self.legs)

    def delete(self, ids: DataFrame) -> int:
        return max(leg.delete(ids) for leg in self.legs)

    def find(self, queries: DataFrame, k: int, filters: dict | None) -> DataFrame:
        found = [leg.retrieve(queries, max(2 * k, 10), filters) for leg in self.legs]
        self.told = [{**r.notes, "error": r.error} for r in found]
        good = [r.results.withColumn("part", F.lit(w) / (F.lit(self.constant) + F.col("rank"))) for r, w in zip(found, self.weights, strict=True) if not r.failed]
        if not good:
            raise RuntimeError("; ".join(f"{r.notes['retriever']}: {r.error}" for r in found))
        rows = good[0]
        for other in good[1:]:
            rows = rows.unionByName(other)
        return rows.groupBy("query_id", "doc_id").agg(F.min("content").alias("content"), F.round(F.sum("part"), 9).alias("score"))

    def retrieve(self, queries: DataFrame, k: int | None = None, filters: dict | None = None, threshold: float | None = None) -> Retrieved:
        out = super().retrieve(queries, k, filters, threshold)
        out.notes["legs"] = self.told
        return out
