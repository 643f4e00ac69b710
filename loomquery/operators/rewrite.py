"""Query rewriting: strategies, variants and fallbacks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.functions.text import parse_lines
from loomquery.plans.config import Settings
from loomquery.plans.llm import complete

#: Question words; stopwords of the keyword fallback.
QUESTION_WORDS = ["吗", "呢", "怎么", "如何", "为什么", "什么", "哪", "是不是"]
STOPWORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人",
    "都", "一个", "上", "也", "很", "到", "说", "要", "去",
    "你", "会", "着", "没有", "看", "好", "自己", "这", "那",
]
#: Additions of ours: question marks and more question words; English stopwords.
MORE_QUESTION_WORDS = ["?", "？", "谁", "多少", "是否"]
MORE_STOPWORDS = ["与", "the", "a", "an", "is", "are", "of", "to", "in", "and", "or"]
STRATEGIES = ["expansion", "decomposition", "hypothesis"]
#: Seconds that a rewrite may take.
TIMEOUT = Settings().rewrite_timeout

_TASK = {
    "expansion": "Write three other ways to ask this question, one a line.\n\n",
    "decomposition": "Split this question into simpler ones, one a line.\n\n",
    "hypothesis": "Write a short passage that would answer this question.\n\n",
    "backoff": "Write a more general form of this question, one line.\n\n",
    "specific": "Write more specific forms of this question, one a line.\n\n",
}


def strategy(q: Column) -> Column:
    """Questions: decomposition if long or with an alternative, else expansion; long statements: specific; others: expansion."""
    question = q.rlike("|".join(re.escape(w) for w in QUESTION_WORDS + MORE_QUESTION_WORDS))
    split = (F.length(q) > 20) | F.contains(q, F.lit("或"))
    return F.when(question, F.when(split, "decomposition").otherwise("expansion")).when(F.length(q) > 30, "specific").otherwise("expansion")


def keywords(q: Column) -> Column:
    """Words and single CJK characters, without stopwords and single letters; none: the query itself."""
    parts = F.filter(F.split(F.regexp_replace(q, "([一-鿿]+)", " $1 "), r"[^\p{L}\p{N}]+"), lambda x: (F.length(x) > 1) & ~F.lower(x).isin(STOPWORDS + MORE_STOPWORDS))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(q))


def prompt(q: Column, kind: Column) -> Column:
    tasks = F.create_map(*[F.lit(x) for p in _TASK.items() for x in p])
    return F.concat(F.try_element_at(tasks, kind), q)


def rewrite(queries: DataFrame, client=None, kind: str | None = None, timeout: float | None = TIMEOUT, cache: DataFrame | None = None) -> DataFrame:
    """(query_id, query, strategy, rewritten, fallback). No reply: the query itself, or its keywords for ``backoff``.

    A call over ``timeout`` seconds counts as no reply. ``cache`` (earlier results of this function) answers
    what it holds; fallbacks aren't taken from it.
    """
    df = queries.withColumn("strategy", F.lit(kind) if kind else strategy(F.col("query")))
    lines = parse_lines(F.coalesce("reply", F.lit("")))
    got = F.size("lines") > 0
    instead = F.when(F.col("strategy") == "backoff", F.array(F.array_join(keywords(F.col("query")), " "))).otherwise(F.array("query"))
    known = None
    if cache is not None:
        held = cache.filter(~F.col("fallback")).groupBy("strategy", "query").agg(F.min("rewritten").alias("lines"))
        known = df.join(held, ["strategy", "query"]).select(*df.columns, "lines")
        df = df.join(held, ["strategy", "query"], "left_anti").select(*df.columns)
    if client:
        asked = complete(df.withColumn("prompt", prompt(F.col("query"), F.col("strategy"))), client, "prompt", "reply", timeout)
    else:
        asked = df.withColumn("reply", F.lit(None).cast("string"))
    told = asked.select(*df.columns, lines.alias("lines"))
    told = told.unionByName(known) if known is not None else told
    return told.select("query_id", "query", "strategy", F.when(got, F.col("lines")).otherwise(instead).alias("rewritten"), (~got).alias("fallback"))


def multi_strategy(queries: DataFrame, client=None, kinds: list[str] | None = None, **options) -> DataFrame:
    """The rewrites of every query by each of several strategies."""
    each = queries.select("*", F.explode(F.array(*[F.lit(k) for k in kinds or STRATEGIES])).alias("_kind"))
    return reduce(DataFrame.unionByName, [rewrite(each.filter(F.col("_kind") == k).drop("_kind"), client, k, **options) for k in kinds or STRATEGIES])


def variants(rewrites: DataFrame) -> DataFrame:
    """(query_id, variant): the query and all its rewrites, each once."""
    one = rewrites.select("query_id", F.explode(F.array_append("rewritten", F.col("query"))).alias("variant"))
    return one.distinct()
