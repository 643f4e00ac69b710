"""7. Mixing sources to target weights by nested hash thresholds.

A document's size is its number of words. Sources, by code point with null last, weigh 5, 2, 1, repeating,
and share ``share`` times all words; no target exceeds ``cap`` times its source's size, and the excess goes
to the others by weight. That is water-filling: target = min(cap * size, level * weight), where the level
is the largest of (rest of the budget / rest of the weight) over sources ordered by cap / weight.

A source then takes floor(target / size) copies of every document and, for the rest of its budget, the
documents below a hash threshold. The threshold is found without sorting: words are summed by source and
the top 12 bits of a 60-bit document hash, the bucket where the running sum passes the budget is split by
the next 12 bits, and so on until the threshold is one hash value. The document at the threshold is taken
in part (``whole=False``), or wholly if that comes nearer to the target (``whole=True``).

Defined results: null text has size 0, takes 0 and still gets a row. Null and empty sources are two
sources. Rows with one doc_id share a hash: they are taken alike, and at the threshold share what is left.
Sources without words have target 0. Reruns agree: the hash depends on doc_id and ``seed`` only. Very long
texts are taken whole. Other columns pass through, whatever their names (but for the prefix ``_lq_``). Empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomquery.llm import common as C

#: Weights in order of source, repeating; the share of all words; the most of a source or a document.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
HASH_BITS, STEP_BITS = 60, 12


def doc_hash(doc_id: str | Column, seed: str = "") -> Column:
    """The first 60 bits of md5(seed + doc_id), as a long."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(c.cast("string"), F.lit("")))), 1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def _digest(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    return docs.withColumn("_lq_size", C.n_words(C.text_of(text_col))).withColumn("_lq_hash", doc_hash(id_col, seed)).withColumn("_lq_key", C.key_of(source_col))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(_lq_key, source_size, target) from rows of (_lq_key, source, source_size)."""
    ranked = C.global_scan(sizes, [F.col("source").asc_nulls_last()])
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = ranked.withColumn("w", F.element_at(cycle, (F.pmod(F.col("_lq_rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    weighed = C.save(weighed.select("_lq_key", "source_size", "w", (F.col("source_size") * cap).alias("cap")), "weights")
    total = weighed.agg(F.sum("source_size").alias("s"), F.sum("w").alias("w")).first()
    budget, weight = share * (total["s"] or 0), total["w"] or 1
    filled = C.global_scan(weighed.withColumn("ratio", F.col("cap") / F.col("w")), [F.col("ratio"), F.col("_lq_key")], {"cum_cap": "cap", "cum_w": "w"})
    rest = (F.lit(budget) - (F.col("cum_cap") - F.col("cap"))) / (F.lit(weight) - (F.col("cum_w") - F.col("w")))
    level = filled.agg(F.max(rest).alias("level")).first()["level"] or 0.0
    return weighed.select("_lq_key", "source_size", F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("w")).alias("target"))


def cuts(digest: DataFrame, aims: DataFrame) -> DataFrame:
    """Each source's copies, threshold hash, words left at the threshold and words of the documents there."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = aims.withColumn("copies", copies).withColumn("rest", F.floor("target") - F.col("copies") * F.col("source_size"))
    state = state.withColumn("prefix", F.lit(0).cast("long"))
    for level in range(HASH_BITS // STEP_BITS):
        shift = HASH_BITS - STEP_BITS * (level + 1)
        rows = digest.select("_lq_key", "_lq_size", F.shiftright("_lq_hash", shift).alias("bucket"))
        if level:  # only the bucket where the budget ends
            rows = rows.withColumn("prefix", F.shiftright("bucket", STEP_BITS)).join(state.select("_lq_key", "prefix"), ["_lq_key", "prefix"], "left_semi")
        sums = rows.groupBy("_lq_key", "bucket").agg(F.sum("_lq_size").alias("words"))
        running = sums.withColumn("cum", F.sum("words").over(Window.partitionBy("_lq_key").orderBy("bucket")))
        passed = running.join(state.select("_lq_key", "rest"), "_lq_key").filter(F.col("cum") > F.col("rest"))
        first = passed.groupBy("_lq_key").agg(F.min(F.struct("bucket", "cum", "words")).alias("f"))
        state = C.save(
            state.drop("prefix", "edge").join(first, "_lq_key").select(
                "_lq_key", "source_size", "target", "copies",
                (F.col("rest") - (F.col("f.cum") - F.col("f.words"))).alias("rest"),
                F.col("f.bucket").alias("prefix"), F.col("f.words").alias("edge"),
            ),
            f"cut{level}",
        )
    return state.select("_lq_key", "copies", F.col("prefix").alias("cut"), F.col("rest").alias("left"), "edge")


def _taken(docs: DataFrame, id_col: str, text_col: str, source_col: str, whole: bool, seed: str, digest: DataFrame | None = None) -> DataFrame:
    """``docs`` with _lq_size, _lq_source_size, _lq_target and _lq_taken."""
    rows = _digest(docs, id_col, text_col, source_col, seed) if digest is None else digest
    small = C.save(rows.select(F.col(source_col).alias("source"), "_lq_key", "_lq_size", "_lq_hash"), "sizes") if digest is None else digest.withColumnRenamed(source_col, "source")
    sizes = small.groupBy("_lq_key").agg(F.first("source").alias("source"), F.sum("_lq_size").alias("source_size"))
    aims = C.save(targets(sizes), "targets")
    cut = cuts(small.select("_lq_key", "_lq_size", "_lq_hash"), aims)
    named = {c: f"_lq_{c}" for c in ("source_size", "target", "copies", "cut", "left", "edge")}
    plan = C.save(aims.join(cut, "_lq_key", "left").withColumnsRenamed(named), "plan")
    found = C.lookup(rows, plan, "_lq_key", F.col("_lq_hash"))
    size = F.col("_lq_size")
    at_cut = (size * (2 * F.col("_lq_left") >= F.col("_lq_edge")).cast("int")) if whole else F.floor(F.col("_lq_left") * (size / F.greatest(F.col("_lq_edge"), F.lit(1))))
    more = F.when(F.col("_lq_hash") < F.col("_lq_cut"), size).when(F.col("_lq_hash") == F.col("_lq_cut"), at_cut).otherwise(F.lit(0))
    taken = F.coalesce(F.col("_lq_copies") * size + more, F.lit(0)).cast("long")
    return found.withColumn("_lq_taken", taken)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole: bool = False, seed: str = "") -> DataFrame:
    """One row per input row: id, size, source_size, target, taken (words taken, repeats counted)."""
    small = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    digest = C.save(_digest(small, "doc_id", "text", "source", seed).drop("text"), "sizes")
    out = _taken(digest, "doc_id", "text", "source", whole, seed, digest)
    return out.select(F.col("doc_id").alias(id_col), *[F.col(f"_lq_{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "") -> DataFrame:
    """``docs`` with each row as often as the mix takes it (0 to 2 times). Documents without a word go: they add none."""
    out = _taken(docs, id_col, text_col, source_col, True, seed)
    copies = F.when(F.col("_lq_size") > 0, F.col("_lq_taken") / F.col("_lq_size")).otherwise(F.lit(0)).cast("int")
    often = out.withColumn("_lq_i", F.explode(F.array_repeat(F.lit(1), copies)))
    return often.select(*docs.columns)
