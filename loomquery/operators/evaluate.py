"""Evaluation of answers: metrics by sample, aggregates, comparisons, test sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomquery.functions.metrics import REGISTRY, cut_metrics
from loomquery.plans.tables import global_scan, save, sized, top

#: Weights of the overall score.
WEIGHTS = {"faithfulness": 0.30, "answer_relevancy": 0.30, "context_recall": 0.25, "context_precision": 0.15}


def evaluate(samples: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """``samples`` (question, answer, ground_truth, contexts) with a column for each metric. Texts are cut once."""
    first, scores = cut_metrics(metrics or list(REGISTRY))
    return samples.withColumns(first).withColumns({m: F.round(c, 6) for m, c in scores.items()}).drop(*first)


def long_form(scores: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric_name, score): a row for each metric; missing scores go."""
    return scores.unpivot(keys, metrics, "metric_name", "score").filter("score is not null")


def wide_form(long: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return long.groupBy(*keys).pivot("metric_name", metrics).agg(F.first("score"))


def distribution(long: DataFrame, by: tuple[str, ...] = ("metric_name",), accuracy: int | None = None) -> DataFrame:
    """Mean, spread and quartiles of each group. Exact quartiles hold a group's distinct scores; ``accuracy`` bounds that by a sketch."""
    cuts = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    q = F.percentile_approx("score", cuts, accuracy) if accuracy else F.percentile("score", cuts)
    out = long.groupBy(*by).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"), q.alias("q"), F.count("*").alias("n"))
    return out.select(*by, *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")], *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p25", "p50", "p75"))], "n")


#: Size parameter of the quantile sketches: rank error about 2.3 / SKETCH ** 0.9, so 0.007 at 600.
SKETCH = 600


def sketches(long: DataFrame, by: tuple[str, ...] = ("metric_name",), size: int = SKETCH) -> DataFrame:
    """(by, sketch): a mergeable quantile sketch of each group's scores, of bounded size, to be stored by run."""
    return long.filter("score is not null").groupBy(*by).agg(F.kll_sketch_agg_double("score", size).alias("sketch"))


def merged(stored: DataFrame, by: tuple[str, ...] = ("metric_name",)) -> DataFrame:
    """(by, sketch): stored sketches merged, over the runs that ``by`` leaves out."""
    return stored.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(stored: DataFrame, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Sketches' rows with n and a column for each quantile (p25, ...). ``distribution`` is the exact way."""
    told = {f"p{round(100 * q):02d}": F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for q in at}
    return stored.withColumns({"n": F.kll_sketch_get_n_double("sketch")} | told).drop("sketch")


def overall(long: DataFrame, weights: dict[str, float] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The mean of the metrics' means, weighted over the metrics present if weights are given."""
    means = long.groupBy(*by, "metric_name").agg(F.avg("score").alias("mean"))
    if weights is None:
        return means.groupBy(*by).agg(F.round(F.avg("mean"), 6).alias("overall"))
    w = F.create_map(*[F.lit(x) for p in weights.items() for x in p])
    weighed = means.withColumn("w", F.coalesce(F.try_element_at(w, F.col("metric_name")), F.lit(0.0)))
    return weighed.groupBy(*by).agg(F.round(F.sum(F.col("mean") * F.col("w")) / F.sum("w"), 6).alias("overall"))


def compare(results: DataFrame, configs: DataFrame, long: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Metric means of each configuration (config, top_k, threshold) over one set of results (…, rank, score)."""
    kept = results.join(sized(configs), (F.col("rank") <= F.col("top_k")) & (F.col("score") >= F.col("threshold")))
    return distribution(long(kept), ("config", "metric_name"))


def testset_buckets(chunks: DataFrame, pairs: int, most: int = 8000) -> DataFrame:
    """(bucket, context, n_chunks): chunks, in order of doc_id, dealt into ``pairs`` contexts of equal count.

    The last rows beyond pairs * (n // pairs) are in no context. Ids and lengths alone are ordered, by a
    global scan; of the texts only those move that begin within a context's first ``most`` characters.
    """
    n = chunks.count()
    size = max(1, n // max(1, pairs))
    lengths = chunks.select("doc_id", (F.coalesce(F.length("text"), F.lit(0)) + 1).cast("long").alias("n_chars"))
    placed = global_scan(lengths, [F.col("doc_id")], {"upto": "n_chars"}).withColumn("bucket", F.floor((F.col("rn") - 1) / size)).filter(F.col("bucket") < pairs)
    placed = save(placed.withColumn("start", F.col("upto") - F.col("n_chars")), "placed")
    whole = save(placed.groupBy("bucket").agg(F.min("start").alias("first"), F.count("*").cast("int").alias("n_chunks")), "buckets")
    used = save(placed.join(sized(whole), "bucket").filter(F.col("start") - F.col("first") < most).select("doc_id", "bucket", "n_chunks"), "used")
    part = F.struct("doc_id", F.coalesce(F.substring("text", 1, most), F.lit("")).alias("text"))
    rows = chunks.select("doc_id", "text").join(sized(used), "doc_id").groupBy("bucket", "n_chunks").agg(F.array_sort(F.collect_list(part)).alias("x"))
    return rows.select("bucket", F.substring(F.array_join(F.transform("x", lambda r: r["text"]), "\n"), 1, most).alias("context"), "n_chunks")


def conversation_samples(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): user turns with the assistant turn that follows."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    nxt = conversations.withColumn("next_role", F.lead("role").over(by)).withColumn("answer", F.lead("text").over(by))
    return nxt.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def last_turns(conversations: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` turns of each conversation, numbered from 1 in order."""
    last = top(conversations, n, ["conv_id"], F.col("turn").desc(), rank="back")
    return last.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).drop("back")


def history(conversations: DataFrame, n: int = 5) -> DataFrame:
    """(conv_id, history): the last turns as numbered lines."""
    rows = last_turns(conversations, n).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "role", "text"))).alias("x"))
    line = lambda r: F.concat(F.lit("第"), r["i"].cast("string"), F.lit("轮 - "), r["role"], F.lit("："), r["text"])
    return rows.select("conv_id", F.array_join(F.transform("x", line), "\n").alias("history"))

