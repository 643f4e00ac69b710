"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.plans import tables
from loomquery.plans.tables import fits, save

__all__ = ["WHITE", "WHITE_RE", "text_of", "words", "n_words", "key_of", "save", "fence", "lookup", "spread_join", "global_scan", "table"]

#: The ASCII white space of every word rule, as characters and as a regex class.
WHITE = " \t\n\x0b\f\r"
WHITE_RE = r"[ \t\n\x0B\f\r]+"

#: A looked-up table of at most so many rows is broadcast; a larger one is joined by salted keys.
BROADCAST_ROWS = 50_000
#: Salts of a lookup that is too large to broadcast, and of a hot key.
SALTS = 32
#: A key is hot if it has over 1 / HOT_SHARE of all rows (so there are fewer hot keys than that) and over HOT_ROWS.
HOT_SHARE, HOT_ROWS = 1000, 64


def text_of(col: str | Column) -> Column:
    """The column as text, null as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text: its longest runs without ASCII white space. No word (or null): an empty array."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WHITE_RE, -1))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def key_of(col: str | Column) -> Column:
    """A never-null string for a nullable column: values stay apart from each other and from null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def fence(df: DataFrame, *cols: str) -> DataFrame:
    """The same rows, with ``cols`` computed once: no later filter is pushed below and evaluates them again.

    (A generator of one element stops predicate push-down, which would copy costly expressions.)
    """
    others = [c for c in df.columns if c not in cols]
    one = df.select(*others, F.explode(F.array(F.struct(*cols))).alias("_lq_fence"))
    return one.select(*others, *[F.col("_lq_fence")[c].alias(c) for c in cols])


def lookup(big: DataFrame, small: DataFrame, key: str, salt_by: Column, how: str = "left") -> DataFrame:
    """Join ``small`` (unique, non-null ``key``, already saved) to ``big`` on ``key``.

    ``small`` is measured: up to BROADCAST_ROWS rows (and the library's bound of bytes) it is broadcast, so a
    hot key never moves. Beyond that both sides are dealt by (key, salt), which spreads a key with a third of
    all rows over SALTS tasks.
    """
    if fits(small, BROADCAST_ROWS):
        return big.join(F.broadcast(small), key, how)
    salted = big.withColumn("_lq_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    each = small.withColumn("_lq_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each, [key, "_lq_salt"], how).drop("_lq_salt")


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], salt_by: Column, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Join ``small`` (unique, non-null ``keys``) to ``big`` (saved), with the rows of hot keys dealt over SALTS tasks.

    Hot keys are counted with map-side sums (or taken from ``counts``: keys and n). There are fewer than
    HOT_SHARE of them, so they are broadcast to both sides; only their rows of ``small`` are repeated.
    """
    counts = big.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    hot = save(counts.filter(F.col("n") > max(HOT_ROWS, big.count() // HOT_SHARE)).select(*keys, F.lit(True).alias("_lq_hot")), "hot")
    if hot.isEmpty():
        return big.join(small, keys, how)
    salted = big.join(F.broadcast(hot), keys, "left").withColumn("_lq_salt", F.when(F.col("_lq_hot"), F.pmod(F.xxhash64(salt_by), F.lit(SALTS))).otherwise(0).cast("int"))
    salts = F.when(F.col("_lq_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    each = small.join(F.broadcast(hot), keys, "left").withColumn("_lq_salt", F.explode(salts)).drop("_lq_hot")
    return salted.drop("_lq_hot").join(each, [*keys, "_lq_salt"], how).drop("_lq_salt")


def global_scan(df: DataFrame, order: list[Column], sums: dict[str, str] | None = None) -> DataFrame:
    """Row numbers (_lq_rank, from 1) and running totals over one global order (``plans.tables``)."""
    return tables.global_scan(df, order, sums, "_lq_rank")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
