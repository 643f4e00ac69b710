"""Answer and retrieval metrics on token sets, as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(c: str | Column) -> Column:
    """Lower-cased words between ASCII white space, distinct."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[ \t\n\x0B\f\r]+"), lambda x: x != ""))


def _share(a: Column, b: Column, factor: float = 1.0) -> Column:
    """The share of a's tokens in b, times factor, at most 1; 0 if a is empty."""
    n = F.size(a)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.size(F.array_intersect(a, b)) / F.greatest(n, F.lit(1)) * factor))


def known(contexts: Column) -> Column:
    """The tokens of all contexts together."""
    return tokens(F.array_join(contexts, " "))


def faithfulness(answer, contexts: Column) -> Column:
    return _share(tokens(answer), known(contexts), 1.5)


def answer_relevancy(question, answer) -> Column:
    return _share(tokens(question), tokens(answer), 2.0)


def context_recall(truth, contexts: Column) -> Column:
    return _share(tokens(truth), known(contexts))


def context_precision(question, contexts: Column) -> Column:
    """Mean of relevance / position over the contexts whose relevance is over a half."""
    return _precision(tokens(question), F.transform(contexts, tokens))


def _precision(q: Column, cut: Column) -> Column:
    rel = F.transform(cut, lambda c: F.least(F.lit(1.0), F.size(F.array_intersect(q, c)) / F.greatest(F.size(q), F.lit(1))))
    hits = F.filter(F.transform(rel, lambda r, i: F.when(r > 0.5, r / (i + 1))), lambda x: x.isNotNull())
    return F.when(F.size(hits) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.aggregate(hits, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(hits), F.lit(1))))


def hit_rate(truth, contexts: Column) -> Column:
    """1 if any context holds at least half of the truth's tokens."""
    return _hit(tokens(truth), F.transform(contexts, tokens))


def _hit(g: Column, cut: Column) -> Column:
    return F.exists(cut, lambda c: F.size(F.array_intersect(g, c)) >= 0.5 * F.size(g)).cast("double")


def sentences(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    parts = F.transform(F.split(c, "[。！？.!?]+"), lambda x: F.regexp_replace(x, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", ""))
    return F.filter(parts, lambda x: x != "")


def sentence_faithfulness(answer, contexts: Column) -> Column:
    """The share of the answer's sentences over 0.3 of whose tokens are in the contexts."""
    return _supported(F.transform(sentences(answer), tokens), known(contexts))


def _supported(every: Column, of: Column) -> Column:
    good = F.filter(every, lambda s: F.size(F.array_intersect(s, of)) / F.greatest(F.size(s), F.lit(1)) > 0.3)
    return F.when(F.size(every) == 0, 0.0).otherwise(F.size(good) / F.greatest(F.size(every), F.lit(1)))


def rank_precision(question, contexts: Column) -> Column:
    """Mean of 1 / position over contexts that share a token with the question, times the number of contexts, at most 1."""
    return _rank_precision(tokens(question), F.transform(contexts, tokens))


def _rank_precision(q: Column, cut: Column) -> Column:
    hits = F.filter(F.transform(cut, lambda c, i: F.when(F.size(F.array_intersect(q, c)) > 0, 1.0 / (i + 1))), lambda x: x.isNotNull())
    mean = F.aggregate(hits, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(hits), F.lit(1))
    return F.when(F.size(hits) == 0, 0.0).otherwise(F.least(F.lit(1.0), mean * F.size(cut)))


#: name: (function, arguments)
REGISTRY: dict[str, tuple[Callable[..., Column], tuple[str, ...]]] = {
    "faithfulness": (faithfulness, ("answer", "contexts")),
    "answer_relevancy": (answer_relevancy, ("question", "answer")),
    "context_recall": (context_recall, ("ground_truth", "contexts")),
    "context_precision": (context_precision, ("question", "contexts")),
    "hit_rate": (hit_rate, ("ground_truth", "contexts")),
    "sentence_faithfulness": (sentence_faithfulness, ("answer", "contexts")),
    "rank_precision": (rank_precision, ("question", "contexts")),
}


#: What the metrics above cut of a sample, and how each reads it: texts are cut once for all metrics of a sample.
CUT: dict[str, Callable[[], Column]] = {
    "_q": lambda: tokens("question"), "_a": lambda: tokens("answer"), "_g": lambda: tokens("ground_truth"), "_s": lambda: F.transform(sentences("answer"), tokens),
    "_c": lambda: F.transform("contexts", tokens), "_k": lambda: known(F.col("contexts")),
}
READS: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "faithfulness": (("_a", "_k"), lambda a, k: _share(a, k, 1.5)), "answer_relevancy": (("_q", "_a"), lambda q, a: _share(q, a, 2.0)), "context_recall": (("_g", "_k"), _share),
    "context_precision": (("_q", "_c"), _precision), "hit_rate": (("_g", "_c"), _hit), "sentence_faithfulness": (("_s", "_k"), _supported), "rank_precision": (("_q", "_c"), _rank_precision),
}


def register(name: str, f: Callable[..., Column], arguments: tuple[str, ...]) -> None:
    REGISTRY[name] = (f, arguments)


def metric(name: str) -> Column:
    """The named metric over the columns question, answer, ground_truth and contexts; null where an input is null."""
    if name not in REGISTRY:
        raise ValueError(f"unknown metric {name}; known: {sorted(REGISTRY)}")
    f, arguments = REGISTRY[name]
    return _present(arguments, f(*[F.col(a) for a in arguments]))


def _present(arguments: tuple[str, ...], value: Column) -> Column:
    here = F.lit(True)
    for a in arguments:
        here = here & F.col(a).isNotNull()
    return F.when(here, value)


def cut_metrics(names: list[str]) -> tuple[dict[str, Column], dict[str, Column]]:
    """Columns to compute first, and the metrics that read them (those of one's own read the texts)."""
    shared = [n for n in names if n in READS and REGISTRY.get(n, (None,))[0] is _BUILT_IN[n]]
    first = {c: CUT[c]() for c in dict.fromkeys(c for n in shared for c in READS[n][0])}
    return first, {n: _present(REGISTRY[n][1], READS[n][1](*[F.col(c) for c in READS[n][0]])) if n in shared else metric(n) for n in names}


_BUILT_IN = {n: f for n, (f, _) in REGISTRY.items()}
