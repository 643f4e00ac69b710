"""Test sets from documents, and the evaluation of answering chains on them."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.functions.text import parse_answer
from loomquery.operators.evaluate import distribution, evaluate, long_form, testset_buckets
from loomquery.plans.llm import Base, Client, complete
from loomquery.plans.rag import Chain
from loomquery.plans.tables import save, sized, top

#: Question types and what they ask for.
TYPES = {
    "factual": "a fact, a definition or a figure",
    "understanding": "an explanation of a concept or a principle",
    "analysis": "reasons, effects or a comparison",
    "summary": "the main points",
}
PAIRS, CONTEXT_CHARACTERS = 10, 8000


class Quizzer(Base):
    """The offline generator: a question that blanks the longest word of the passage's longest sentence, as JSON."""

    def invoke(self, prompt: str) -> str:
        body = prompt.split("## Passage\n", 1)[-1].split("\n## ", 1)[0]
        sentences = [s.strip() for s in re.split(r"(?<=[.!?。！？])\s+|\n", body) if s.strip()]
        if not sentences:
            return ""
        best = max(sentences, key=lambda s: (len(s), s))
        word = max(re.findall(r"\w+", best) or [best], key=lambda w: (len(w), w))
        return json.dumps({"question": f"Which word is missing: {best.replace(word, '____', 1)}?", "answer": best}, ensure_ascii=False)


def generation_prompt(context: Column, truth: Column | None = None, types: list[str] | None = None) -> Column:
    """The request for one question and its answer from a passage."""
    wanted = "\n".join(f"- {t}: {TYPES.get(t, '')}" for t in types or list(TYPES))
    given = F.when(F.coalesce(truth, F.lit("")) != "", F.concat(F.lit("\n## Known answer\n"), truth)).otherwise("") if truth is not None else F.lit("")
    task = "Write one question that the passage answers, clear and specific, with a full and correct answer."
    rules = f"\n## Rules\n{task}\n## Types (take the fittest)\n{wanted}\n## Output\nJSON only, with the keys question and answer."
    return F.concat(F.lit("Write a test question.\n## Passage\n"), F.substring(context, 1, CONTEXT_CHARACTERS), given, F.lit(rules))


def from_contexts(contexts: DataFrame, factory: Callable[[], Client] = Quizzer, pairs: int = PAIRS, types: list[str] | None = None, order: str = "bucket") -> DataFrame:
    """(question, answer, ground_truth_context, metadata): the first ``pairs`` contexts (order, context[, ground_truth]) that the client makes a question of.

    Replies that hold no question leave no sample.
    """
    truth = F.col("ground_truth") if "ground_truth" in contexts.columns else None
    asked = contexts.withColumn("prompt", generation_prompt(F.col("context"), truth, types))
    told = save(complete(asked, factory).withColumn("x", parse_answer("reply")), "samples")
    answer = F.coalesce("x.answer", truth) if truth is not None else F.col("x.answer")
    good = told.filter(F.col("x.question").isNotNull() & (F.col("x.question") != "")).withColumn("one", F.lit(0))
    metadata = F.create_map(F.lit(order), F.col(order).cast("string"))
    first = top(good, pairs, ["one"], F.col(order), rank="place")
    context = F.substring("context", 1, CONTEXT_CHARACTERS).alias("ground_truth_context")
    return first.select(F.col("x.question").alias("question"), F.coalesce(answer, F.lit("")).alias("answer"), context, metadata.alias("metadata"))


def from_documents(chunks: DataFrame, factory: Callable[[], Client] = Quizzer, pairs: int = PAIRS, types: list[str] | None = None) -> DataFrame:
    """Samples from chunks (doc_id, text), dealt into ``pairs`` contexts in order."""
    return from_contexts(testset_buckets(chunks, pairs, CONTEXT_CHARACTERS), factory, pairs, types)


def run_chain(samples: DataFrame, chain: Chain, metrics: list[str] | None = None, k: int | None = None) -> DataFrame:
    """Samples (question, answer, ground_truth_context) asked of a chain and scored: one plan for all.

    The sample's answer is the ground truth; ``answer`` and ``contexts`` are what the chain said and found.
    Samples without a reply go.
    """
    asked = save(samples.withColumn("query_id", F.monotonically_increasing_id()).withColumn("query", F.col("question")), "asked")
    queries = asked.select("query_id", "query")
    found = save(chain.retrieve(queries, k or chain.k), "retrieved")
    replies = Chain(lambda *_: found, chain.factory, chain.k, chain.threshold).invoke(queries)
    contexts = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("contexts"))
    rows = asked.select("query_id", "question", F.col("answer").alias("ground_truth")).join(replies.select("query_id", "answer"), "query_id").filter("answer is not null")
    rows = rows.join(sized(contexts), "query_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    return evaluate(rows.drop("query_id"), metrics)


def evaluate_chain(samples: DataFrame, chain: Chain, metrics: list[str] | None = None) -> dict:
    """Scores, their distribution and the seconds it took."""
    began = time.time()
    scores = save(run_chain(samples, chain, metrics), "scores")
    named = metrics or [c for c in scores.columns if c not in ("question", "ground_truth", "answer", "contexts")]
    summary = [r.asDict() for r in distribution(long_form(scores, ["question"], named)).orderBy("metric_name").collect()]
    return {"scores": scores, "metrics": summary, "seconds": time.time() - began}


def evaluate_documents(chunks: DataFrame, chain: Chain, factory: Callable[[], Client] = Quizzer, pairs: int = PAIRS, metrics: list[str] | None = None) -> dict:
    """A test set made from chunks, then the chain's scores on it."""
    return evaluate_chain(save(from_documents(chunks, factory, pairs), "testset"), chain, metrics)
