"""Exact vector search for batches of queries, semantic retrieval and similarity matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomquery.functions import vector as V
from loomquery.plans.ship import ship
from loomquery.plans.tables import fits, top

#: Queries of a block; vectors of a chunk; distances that a task holds at a time.
BLOCK, CHUNK, CELLS = 4096, 8192, 1 << 22
#: Results of a query where none or zero is asked for.
TOP_K = 10


def _blocks(queries: DataFrame, block: int = BLOCK) -> list[DataFrame]:
    """The queries in parts of about ``block`` rows, by a hash of their id."""
    n = -(-queries.count() // block)
    return [queries] if n <= 1 else [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(2 * n)) == i) for i in range(2 * n)]


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows) distances; the formulas of ``functions.vector``."""
    if metric == "cosine":
        return 1 - (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :] + V.EPSILON)
    if metric == "manhattan":
        return np.stack([np.abs(x - v).sum(axis=1) for v in q])
    return np.stack([np.sqrt(((x - v) ** 2).sum(axis=1)) for v in q])


def _nearest(rows: DataFrame, block: DataFrame, id_col: str, k: int, metric: str, exclude_self: bool) -> DataFrame:
    """(query_id, id, distance): of each Arrow batch the ``k`` nearest of each query, and what ties with the last."""
    spark, kind = rows.sparkSession, V.metric_name(metric)
    ship(spark)
    asked = block.select("query_id", F.col("query").cast("array<double>").alias("query")).filter("query is not null").toArrow()
    ids = asked.column("query_id").to_pylist()
    matrix = np.array(asked.column("query").to_pylist(), dtype=np.float64).reshape(len(ids), -1) if ids else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast((ids, matrix))
    schema = T.StructType([T.StructField("query_id", block.schema["query_id"].dataType), T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, q = shared.value
        own_ids = pa.array(own)
        for batch in batches:
            step = max(1, CELLS // max(1, len(own)))
            for at in range(0, batch.num_rows if own else 0, step):
                part = batch.slice(at, step)
                x = np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(part.num_rows, -1)
                d = _distances(q, x, kind).round(6)
                if exclude_self:
                    there = {v: j for j, v in enumerate(part.column(0).to_pylist())}
                    for i, v in enumerate(own):
                        if v in there:
                            d[i, there[v]] = np.inf
                last = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                i, j = np.nonzero((d <= last[:, None]) & np.isfinite(d))
                yield pa.RecordBatch.from_arrays([own_ids.take(pa.array(i)), part.column(0).take(pa.array(j)), pa.array(d[i, j])], names=schema.names)

    return rows.select(id_col, F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding is not null").mapInArrow(run, schema)


def scorer(k: int, metric: str, schema: T.StructType, exclude_self: bool = False):
    """Of a group of vectors (id, v) and one of queries (query_id, query): the ``k`` nearest of each query, and what ties with the last."""

    def run(rows, asked):
        import pyarrow as pa
        import pyarrow.compute as pc

        found = []
        if rows.num_rows and asked.num_rows:
            matrix = lambda c: np.asarray(c.combine_chunks().flatten()).reshape(len(c), -1)
            x, q, own = matrix(rows.column("v")), matrix(asked.column("query")), None
            if exclude_self:
                known = pc.unique(rows.column("id"))
                own = [pc.index_in(c, value_set=known).fill_null(-1).to_numpy() for c in (asked.column("query_id"), rows.column("id"))]
            step = max(1, CELLS // len(x))
            for at in range(0, len(q), step):
                d = _distances(q[at : at + step], x, metric).round(6)
                if own:
                    d[own[0][at : at + step, None] == own[1][None, :]] = np.inf
                n = min(k, d.shape[1])
                i, j = np.nonzero((d <= np.partition(d, n - 1, axis=1)[:, n - 1 : n]) & np.isfinite(d))
                found.append(pa.table([asked.column("query_id").take(pa.array(i + at)), rows.column("id").take(pa.array(j)), pa.array(d[i, j])], names=schema.names))
        if found:
            return pa.concat_tables(found)
        return pa.table([asked.column("query_id").slice(0, 0), rows.column("id").slice(0, 0), pa.array([], pa.float64())], names=schema.names)

    return run


def _paired(rows: DataFrame, queries: DataFrame, id_col: str, k: int, metric: str, exclude_self: bool) -> DataFrame:
    """(query_id, id, distance) for any number of queries: blocks of them meet chunks of vectors in groups of bounded size, by one shuffle."""
    ship(rows.sparkSession)
    held = rows.select(F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter("v is not null")
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).filter("query is not null")
    chunks, blocks = max(1, -(-rows.count() // CHUNK)), max(1, -(-queries.count() // BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = held.withColumn("chunk", deal("id", chunks)).withColumn("block", each(blocks))
    right = asked.withColumn("block", deal("query_id", blocks)).withColumn("chunk", each(chunks))
    schema = T.StructType([queries.schema["query_id"], held.schema["id"], T.StructField("distance", T.DoubleType())])
    met = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block"))
    return met.applyInArrow(scorer(k, V.metric_name(metric), schema, exclude_self), schema).withColumnRenamed("id", id_col)


def search(vectors: DataFrame, queries: DataFrame, k: int | None = None, metric: str = "cosine", where: Column | None = None, id_col: str = "vec_id", exclude_self: bool = False) -> DataFrame:
    """(query_id, id, distance, rank): the ``k`` nearest of each query (query_id, query).

    ``where`` filters before the search. Queries of a checked size (BLOCK rows, and bytes) are sent to all tasks and
    multiplied with their vectors batch by batch; more of them are dealt in blocks that meet chunks of vectors. A group
    limit keeps ``k`` of a query in each task before anything is shuffled. Vectors and queries that are null are left out.
    """
    rows, k = vectors.filter(where) if where is not None else vectors, k or TOP_K
    near = _nearest if fits(queries, BLOCK) else _paired
    found = near(rows, queries, id_col, k, metric, exclude_self)
    return top(found, k, ["query_id"], F.col("distance"), F.col(id_col))


def retrieve(vectors: DataFrame, queries: DataFrame, contents: DataFrame, k: int = 5, metric: str = "cosine", threshold: float | None = None, where: Column | None = None) -> DataFrame:
    """Semantic retrieval: top ``k``, then one row per content, then the score threshold, then ranks.

    ``contents`` has (vec_id, content). Fewer than ``k`` rows may be left.
    """
    found = search(vectors, queries, k, metric, where).drop("rank").join(contents, "vec_id")
    order = [F.col("distance"), F.col("vec_id")]
    once = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "content").orderBy(*order))).filter("n = 1").drop("n")
    scored = once.withColumn("score", F.round(V.score(F.col("distance"), metric, clamp=True), 6))
    if threshold is not None:
        scored = scored.filter(F.col("score") >= threshold)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))


#: Pairs of a task and of an Arrow batch of the similarity matrix.
PAIRS, PAIRS_BATCH = 1 << 25, 1 << 19


def similarity_matrix(a: DataFrame, b: DataFrame, normalized: bool = False) -> DataFrame:
    """(id_a, id_b, similarity) of all pairs of two sets (vec_id, embedding); null for a null vector or one with null elements.

    ``b`` goes in blocks of about BLOCK rows that are sent to all tasks; a task multiplies its rows of ``a`` with a block matrix by matrix
    and hands back PAIRS_BATCH pairs at a time, so memory is bounded; the result itself has as many rows as there are pairs.
    """
    spark = a.sparkSession
    ship(spark)
    whole = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.col(c).cast("array<double>"))
    rows, n = a.select(F.col("vec_id").alias("id_a"), whole("embedding").alias("va")), a.count()
    schema = T.StructType([T.StructField("id_a", rows.schema["id_a"].dataType), T.StructField("id_b", b.schema["vec_id"].dataType), T.StructField("similarity", T.DoubleType())])
    out = None
    for block in _blocks(b.select(F.col("vec_id").alias("query_id"), whole("embedding").alias("vb"))):
        asked = block.toArrow()  # about BLOCK rows
        shared = spark.sparkContext.broadcast((asked.column("query_id").to_pylist(), asked.column("vb").to_pylist()))
        dealt = rows.repartition(max(1, -(-n * len(asked) // PAIRS)), "id_a") if n * len(asked) > PAIRS else rows
        part = dealt.mapInArrow(_all_pairs(shared, normalized, schema), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _all_pairs(shared, normalized: bool, schema: T.StructType):
    """Of Arrow batches of (id_a, va): every row with every vector of the broadcast block."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, vectors = shared.value
        there = np.array([v is not None for v in vectors], dtype=bool)
        q = np.array([v for v in vectors if v is not None], dtype=np.float64).reshape(int(there.sum()), -1) if there.any() else np.zeros((0, 1))
        size, own_ids = np.linalg.norm(q, axis=1), pa.array(own)
        for batch in batches:
            step = max(1, PAIRS_BATCH // max(1, len(own)))
            for at in range(0, batch.num_rows if own else 0, step):
                part = batch.slice(at, step)
                held = part.column(1).is_valid().to_numpy(zero_copy_only=False)
                s = np.full((part.num_rows, len(own)), np.nan)
                if held.any() and there.any():
                    x = np.asarray(part.column(1).drop_null().flatten()).reshape(int(held.sum()), -1)
                    dot = x @ q.T
                    s[np.ix_(held, there)] = (dot if normalized else dot / (np.linalg.norm(x, axis=1)[:, None] * size[None, :] + V.EPSILON)).round(6)
                none = ~(held[:, None] & there[None, :])
                i = pa.array(np.repeat(np.arange(part.num_rows), len(own)))
                j = pa.array(np.tile(np.arange(len(own)), part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column(0).take(i), own_ids.take(j), pa.array(s.ravel(), mask=none.ravel() if none.any() else None)], names=schema.names)

    return run
