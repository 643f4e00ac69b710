"""Retrieval-augmented answering as one plan: retrieve, format, prompt, complete."""

from __future__ import annotations

import asyncio
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.functions.text import truncate_context
from loomquery.plans.llm import Client, Extractive, complete
from loomquery.plans.tables import save

#: What stands between contexts, and what for none.
SEPARATOR = "\n\n---\n\n"
NO_CONTEXT = "没有找到相关的文档信息。"
SYSTEM = "You answer from the given documents only. Say so if they don't hold the answer."


def format_contexts(results: DataFrame, page: str | None = None) -> DataFrame:
    """(query_id, context): numbered passages with their source (and page), in order of rank.

    ``results`` has query_id, rank, content and source.
    """
    where = F.concat(F.lit(", 页码: "), F.col(page).cast("string")) if page else F.lit("")
    head = F.concat(F.lit("[文档 "), F.col("rank").cast("string"), F.lit("] 来源: "), F.coalesce("source", F.lit("unknown")), F.coalesce(where, F.lit("")), F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct("rank", F.concat(head, F.col("content")).alias("text"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), SEPARATOR).alias("context"))


def qa_prompt(question: Column, context: Column, history: Column | None = None, system: str = SYSTEM) -> Column:
    past = F.when(history.isNotNull(), F.concat(F.lit("\n\nConversation so far:\n"), history)).otherwise("") if history is not None else F.lit("")
    body = truncate_context(F.coalesce(context, F.lit(NO_CONTEXT)))
    return F.concat(F.lit(system), past, F.lit("\n\nDocuments:\n"), body, F.lit("\n\nQuestion: "), question)


def refine_prompt(question: Column, answer: Column, context: Column) -> Column:
    return F.concat(F.lit("Improve the answer with the new passage.\n\nQuestion: "), question, F.lit("\nAnswer: "), answer, F.lit("\nPassage:\n"), truncate_context(context))


def critique_prompt(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Name the faults of this answer.\n\nQuestion: "), question, F.lit("\nAnswer: "), answer)


def summary_prompt(text: Column) -> Column:
    return F.concat(F.lit("Summarise:\n\n"), truncate_context(text))


def search_prompt(query: Column) -> Column:
    """Asks for what a hybrid search needs of a question: keywords for one leg, a sentence for the other."""
    return F.concat(F.lit("Prepare a search. On the first line give the question's keywords, on the second a sentence that an answer would hold.\n\nQuestion: "), query)


def condense_prompt(question: Column, history: Column) -> Column:
    return F.concat(F.lit("Restate the last question so that it stands alone.\n\n"), F.coalesce(history, F.lit("无")), F.lit("\n\nQuestion: "), question)


def answer(queries: DataFrame, results: DataFrame, factory: Callable[[], Client] = Extractive, threshold: float = 0.5) -> DataFrame:
    """(query_id, question, answer, sources, num_retrieved, retrieval_scores) for each query, found passages or not."""
    kept = results.filter(F.col("score") >= threshold)
    rows = F.array_sort(F.collect_list(F.struct("rank", "source", "score")))
    found = kept.groupBy("query_id").agg(rows.alias("r")).join(format_contexts(kept), "query_id")
    asked = queries.join(found, "query_id", "left").withColumn("prompt", qa_prompt(F.col("query"), F.col("context")))
    replied = complete(asked.select("query_id", "query", "prompt"), factory).select("query_id", F.col("reply").alias("answer"))
    none = lambda kind: F.array().cast(kind)
    return asked.join(replied, "query_id").select(
        "query_id", F.col("query").alias("question"), "answer",
        F.coalesce(F.array_distinct(F.transform("r", lambda x: x["source"])), none("array<string>")).alias("sources"),
        F.coalesce(F.size("r"), F.lit(0)).alias("num_retrieved"),
        F.coalesce(F.transform("r", lambda x: x["score"]), none("array<double>")).alias("retrieval_scores"),
    )


def stream(question: str, context: str, client: Extractive | None = None):
    """Pieces of one answer, on the driver."""
    yield from (client or Extractive()).stream(f"{SYSTEM}\n{context}\n{question}")


class Store(Protocol):
    """What a chain needs of a store; ``sources.collections.KnowledgeBase`` is one."""

    def add_documents(self, docs: DataFrame) -> int: ...

    def search(self, queries: DataFrame, k: int = 5, filters: dict | None = None, threshold: float | None = None) -> DataFrame: ...

    def delete(self, ids: list[str]) -> bool: ...


@dataclass
class Chain:
    """Retrieve, prompt and complete for a batch of queries (query_id, query).

    ``retrieve`` is a function of (queries, k) to results (query_id, rank, score, source, content).
    """

    retrieve: Callable[[DataFrame, int], DataFrame]
    factory: Callable[[], Client] = Extractive
    k: int = 5
    threshold: float = 0.5

    @classmethod
    def of_store(cls, store: Store, **options) -> Chain:
        return cls(lambda queries, k: store.search(queries.select("query_id", F.col("query").alias("text")), k), **options)

    def invoke(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        found = save(self.retrieve(queries, k or self.k), "retrieved")
        return answer(queries, found, self.factory, self.threshold)

    async def ainvoke(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """The same from a thread of its own: Spark runs jobs of several threads side by side."""
        return await asyncio.to_thread(lambda: save(self.invoke(queries, k), "answers"))

    def stream(self, spark: SparkSession, question: str):
        """Pieces of the answer to one question."""
        q = spark.createDataFrame([(0, question)], "query_id long, query string")
        kept = self.retrieve(q, self.k).filter(F.col("score") >= self.threshold)
        row = format_contexts(kept).first()
        yield from self.factory().stream(f"{SYSTEM}\n{row['context'] if row else NO_CONTEXT}\n{question}")
