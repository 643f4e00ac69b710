"""1. Quality rules with risk-controlled thresholds.

Each document gets base counts and a severity level from 0 to LEVELS: the highest grid step that one of
its signals (symbols, repeated words, repeated lines, word length, capitals) reaches. Labelled good
documents that pass the base rules are the holdout. For each stratum the levels are tested from the most
extreme one down (a fixed sequence, so levels need no correction; strata share ``delta`` by Bonferroni):
level L is certified while the exact binomial lower tail P(Bin(n, alpha) <= k) is at most delta / tests,
where k of the stratum's n good holdout documents reach L. Documents at or above the lowest certified
level are rejected.

A stratum is small if even no false rejection among its n documents would pass its test. All small strata
together make one pooled stratum, which counts as a test of its own; its cut applies to each of them. (Which
strata are small depends on their numbers only, not on levels.)

What the bound covers: with confidence 1 - delta, in no stratum (and not in the pool as a whole) do the
levels reject more than ``alpha`` of the good documents that pass the base rules. The base rules are given,
not chosen, and what they reject is not in the bound. A stratum without any holdout document is neither
tested nor pooled: only the base rules reject there.

The grid is fixed and even, from where a signal is unusual in prose to where it is absurd; it isn't fitted.

Defined results: null text counts as empty (no words, base_failed). A null stratum is a stratum of its
own. A stratum with no certified level rejects by base rules only. Repeated rows each get a row; in the
holdout all rows of one doc_id count once, by their highest level. Labels that contradict each other or
are null are not used. Very long texts are taken whole. Other columns of the documents, whatever their
names (but for the prefix ``_lq_``), are not touched. Empty tables give empty results.

Repeated windows are found by 64-bit hashes of three words within one text (two different windows of a
text share a hash with a chance under 1e-10 even for 20,000 words).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomquery.llm import common as C

ALPHA, DELTA, LEVELS = 0.05, 0.05, 10
#: The stratum that holds all strata too small for a test.
POOL = "small strata"

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _even(first: float, step: float) -> list[float]:
    return [round(first + step * i, 2) for i in range(LEVELS)]


#: Cutoffs of levels 1 to LEVELS, in even steps. A signal reaches a level if it is over ("<": under) its cutoff.
GRID = {
    "symbols": (">", _even(0.05, 0.05)),
    "repeats": (">", _even(0.30, 0.02)),
    "lines": (">", _even(0.50, 0.05)),
    "long_words": (">", _even(10.0, 2.0)),
    "short_words": ("<", _even(3.0, -0.2)),
    "capitals": (">", _even(0.40, 0.05)),
}
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Words inside three-word windows that occur again: repeated windows by position, then the length of their union.
_REPEATED = """
case when size(array_distinct(_lq_h)) = size(_lq_h) then 0L else
aggregate(
  sort_array(transform(
    filter(_lq_s, (e, j) -> (j > 0 and _lq_s[j - 1].x = e.x) or (j < size(_lq_s) - 1 and _lq_s[j + 1].x = e.x)),
    e -> e.i)),
  named_struct('last', -3, 'n', 0L),
  (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)),
  a -> a.n) end
"""


def with_metrics(docs: DataFrame, text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``docs`` with ``_lq_`` columns: the five counts, base_failed, level and stratum key."""
    text = C.text_of(text_col)
    df = docs.withColumn("_lq_w", C.words(text)).withColumn("_lq_n_words", F.size("_lq_w").cast("long"))
    df = df.withColumn("_lq_h", F.expr("transform(slice(_lq_w, 1, greatest(size(_lq_w) - 2, 0)), (x, i) -> xxhash64(x, _lq_w[i + 1], _lq_w[i + 2]))"))
    df = df.withColumn("_lq_s", F.expr("case when size(array_distinct(_lq_h)) < size(_lq_h) then sort_array(transform(_lq_h, (x, i) -> named_struct('x', x, 'i', i))) end"))
    df = df.withColumn("_lq_n_repeat_words", F.expr(_REPEATED)).drop("_lq_w", "_lq_h", "_lq_s")
    df = df.withColumn("_lq_l", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")))
    df = df.withColumn("_lq_n_lines", F.size("_lq_l")).withColumn("_lq_n_dup_lines", (F.size("_lq_l") - F.size(F.array_distinct("_lq_l"))).cast("long")).drop("_lq_l")
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    df = df.withColumn("_lq_word_chars", without(C.WHITE_RE).cast("long"))
    df = df.withColumn("_lq_n_symbols", (F.length(text) - without(r"[#*$%&|<>]+")).cast("long"))
    df = df.withColumn("_lq_caps", F.length(text) - without("[A-Z]+"))
    chars, n = F.greatest(F.col("_lq_word_chars"), F.lit(1)), F.greatest(F.col("_lq_n_words"), F.lit(1))
    signals = {
        "symbols": F.col("_lq_n_symbols") / chars,
        "repeats": F.col("_lq_n_repeat_words") / n,
        "lines": F.col("_lq_n_dup_lines") / F.greatest(F.col("_lq_n_lines"), F.lit(1)),
        "long_words": F.col("_lq_word_chars") / n,
        "short_words": F.col("_lq_word_chars") / n,
        "capitals": F.col("_lq_caps") / chars,
    }
    df = df.withColumn("_lq_base_failed", (F.col("_lq_n_words") < 50) | (100 * F.col("_lq_n_repeat_words") > 50 * F.col("_lq_n_words")))
    df = df.withColumn("_lq_level", F.greatest(*[_level(signals[k], op, cuts) for k, (op, cuts) in GRID.items()]))
    return df.withColumn("_lq_stratum", C.key_of(stratum_col)).drop("_lq_n_lines", "_lq_caps")


def _level(value: Column, op: str, cuts: list[float]) -> Column:
    """How many cutoffs in a row the value passes: counted in a constant array, which is less code to compile than a sum of comparisons."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: value > c if op == ">" else value < c))


def lower_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k <= n p, else 1 (no test passes there).

    The term at k comes from the log-gamma series; the terms below it follow by ratio. Twelve standard
    deviations of them (and 60 more) hold the tail to double precision.
    """

    def log_gamma(x: Column) -> Column:
        y = x + 8
        shift = sum((F.log(x + i) for i in range(1, 8)), F.log(x))
        return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift

    n, k = n.cast("double"), k.cast("double")
    first = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    span = F.least(k, F.ceil(12 * F.sqrt(n * p)) + 60).cast("int")
    tail = F.aggregate(
        F.sequence(F.lit(0), span),
        F.struct(first.alias("t"), F.lit(0.0).alias("s")),
        lambda a, j: F.struct((a["t"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("t"), (a["s"] + a["t"]).alias("s")),
        lambda a: a["s"],
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(tail, F.lit(1.0)))


def thresholds(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, tested, min_level, n_good, false_rejects, p_value): the lowest certified level of each stratum that has one.

    ``tested`` is the stratum itself or POOL. ``measured`` has id_col, _lq_stratum, _lq_level and
    _lq_base_failed; ``labels`` has id_col and quality.
    """
    good = labels.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("a"), F.max("quality").alias("b")).filter("a = 1 and b = 1").select(id_col)
    held = measured.filter(~F.col("_lq_base_failed") & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("_lq_stratum").alias("stratum"), F.max("_lq_level").alias("level"))
    counts = C.save(held.join(good, id_col, "left_semi").groupBy("stratum", "level").agg(F.count("*").alias("n")), "holdout")
    sizes = counts.groupBy("stratum").agg(F.sum("n").alias("size"))
    tests = sizes.count() + 1
    small = F.pow(F.lit(1 - alpha), F.col("size")) > delta / tests
    groups = C.save(sizes.select("stratum", F.when(small, POOL).otherwise(F.col("stratum")).alias("tested")), "strata")
    levels = counts.join(groups, "stratum").groupBy("tested", "level").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("tested")
    down = by.orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = levels.unionByName(groups.select("tested").distinct().select("tested", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"), F.lit(0).cast("long").alias("n")))
    cum = every.groupBy("tested", "level").agg(F.sum("n").alias("n")).select("tested", "level", F.sum("n").over(by).alias("n_good"), F.sum("n").over(down).alias("false_rejects"))
    tails = cum.filter("level > 0").withColumn("p_value", lower_tail(F.col("n_good"), F.col("false_rejects"), alpha))
    passed = tails.withColumn("ok", F.min((F.col("p_value") <= delta / tests).cast("int")).over(down)).filter("ok = 1")
    lowest = passed.groupBy("tested").agg(F.min_by(F.struct(F.col("level").alias("min_level"), "n_good", "false_rejects", "p_value"), "level").alias("x"))
    return groups.join(lowest, "tested").select("stratum", "tested", "x.*")


def _judged(measured: DataFrame, certified: DataFrame, salt_by: Column) -> DataFrame:
    cut = C.save(certified.select(F.col("stratum").alias("_lq_stratum"), F.col("min_level").alias("_lq_min")), "cuts")
    found = C.lookup(measured, cut, "_lq_stratum", salt_by)
    return found.withColumn("_lq_kept", ~F.col("_lq_base_failed") & F.coalesce(F.col("_lq_level") < F.col("_lq_min"), F.lit(True)))


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per input row: id, counts, base_failed, level, min_level, kept."""
    small = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(stratum_col).alias("lang"))
    measured = C.save(with_metrics(small).drop("text", "lang"), "metrics")
    cut = thresholds(measured, labels.select(F.col(id_col).alias("doc_id"), "quality"), "doc_id", alpha, delta)
    out = _judged(measured, cut, F.col("doc_id"))
    named = {**{m: m for m in METRICS}, "base_failed": "base_failed", "level": "level", "min": "min_level", "kept": "kept"}
    return out.select(F.col("doc_id").alias(id_col), *[F.col(f"_lq_{c}").alias(name) for c, name in named.items()])


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``docs`` without the rejected rows.

    Documents are measured once: those that pass the base rules are written with their level, and the
    verdict is a filter on that table. Texts are not shuffled.
    """
    marks = ["_lq_stratum", "_lq_level", "_lq_base_failed"]
    measured = with_metrics(docs, text_col, stratum_col).select(*docs.columns, *marks)
    passing = C.save(C.fence(measured, *marks).filter(~F.col("_lq_base_failed")), "passing")
    cut = thresholds(passing.select(id_col, *marks), labels.select(id_col, "quality"), id_col, alpha, delta)
    return _judged(passing, cut, F.col(id_col)).filter("_lq_kept").select(*docs.columns)
