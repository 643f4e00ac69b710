"""A stored vector index: lists of vectors around centroids, read by list.

``VectorIndex.build`` fits centroids on a bounded sample (SAMPLE rows by a hash of the id) and deals *every* row to the list of
its nearest centroid. Lists are partitions of the stored table, so a search reads the partitions of the lists that its
queries probe and no others. A list of more than CHUNK rows has several parts, so a cluster with a third of all
vectors is as many groups of bounded size.

A search deals each query to the lists of its nearest centroids (``probes`` of them), meets the parts of these
lists by a shuffle on (list, part, block of queries) and multiplies matrices group by group; a group limit keeps ``k`` of a
query before the last shuffle. How many probes reach a recall is measured against the exact search when the index is
built (``probes_for``) and stored with it. All lists probed is the exact search, with the rows of ``knn.search``.

Null vectors are left out; repeated ids are rows of their own; ties go by id. Vectors all have one length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomquery.functions import vector as V
from loomquery.operators import knn
from loomquery.plans.ship import ship
from loomquery.plans.tables import save, sized, top

#: Rows that centroids are fitted on; lists at most, and rows of the sample for each; turns of the fit.
SAMPLE, LISTS, EACH, TURNS = 20_000, 1024, 16, 12
#: Rows of a list's part; recall that the stored number of probes reaches on PROBED sampled queries.
CHUNK, RECALL, PROBED = 8192, 0.95, 200


def _sides(x: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows to centroids in the metric of the index."""
    return knn._distances(np.asarray(x, dtype=np.float64), centroids, metric)


def fit(x: np.ndarray, lists: int, metric: str = "cosine", seed: int = 7) -> np.ndarray:
    """``lists`` centroids of a sample by k-means; for cosine of directions."""
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), V.EPSILON)
    rng = np.random.default_rng(seed)
    centroids = x[np.sort(rng.choice(len(x), lists, replace=False))].copy()
    for _ in range(TURNS):
        near = np.argmin(_sides(x, centroids, metric), axis=1)
        sums, n = np.zeros_like(centroids), np.bincount(near, minlength=lists)
        np.add.at(sums, near, x)
        # an empty list starts again at some row
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), lists)])
    return centroids


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("v is not null")


def _nearest_lists(rows: DataFrame, centroids: np.ndarray, metric: str, probes: int) -> DataFrame:
    """(id, v, list, turn): each row once for each of its ``probes`` nearest centroids, the nearest at turn 1."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType([rows.schema["id"], T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("list", T.IntegerType()), T.StructField("turn", T.IntegerType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = shared.value
        for batch in batches:
            # what is held and what is handed back are bounded: distances to the lists, and a vector for each probe
            width = len(batch.column(1).flatten()) // max(1, batch.num_rows)
            step = max(1, knn.CELLS // max(len(c), 4 * width * min(probes, len(c))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                d = _sides(np.asarray(part.column(1).flatten()).reshape(part.num_rows, -1), c, metric)
                near = np.argsort(d, axis=1, kind="stable")[:, :probes] if probes > 1 else np.argmin(d, axis=1)[:, None]
                row = pa.array(np.repeat(np.arange(part.num_rows), near.shape[1]))
                turn = np.tile(np.arange(1, near.shape[1] + 1, dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(near.ravel().astype(np.int32)), pa.array(turn)], names=schema.names)

    return rows.select("id", "v").mapInArrow(run, schema)


class VectorIndex:
    """Under ``path``: rows (id, v, part) by ``list``, ``lists`` (list, n, centroid) and ``about.json``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.about = json.loads("\n".join(r["value"] for r in spark.read.text(f"{self.path}/about.json").collect()))
        self.metric, self.probes = self.about["metric"], self.about["probes"]
        # LISTS rows at most
        self.lists = spark.read.parquet(f"{self.path}/lists").orderBy("list").toArrow()
        self.centroids = np.array(self.lists.column("centroid").to_pylist(), dtype=np.float64).reshape(len(self.lists), -1 if len(self.lists) else 1)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "cosine", lists: int | None = None, recall: float = RECALL) -> VectorIndex:
        """Write an index of all vectors; ``lists`` (about the root of their number unless given) and probes for ``recall``."""
        spark, kind = vectors.sparkSession, V.metric_name(metric)
        rows = save(_vectors(vectors, id_col, vector_col), "vectors")
        n = rows.count()
        share = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(min(1.0, 1.1 * SAMPLE / max(n, 1)) * (1 << 40))
        sample = np.array([r["v"] for r in rows.filter(share).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().to_pylist()], dtype=np.float64)
        wanted = lists or int(n**0.5)
        k = max(1, min(wanted, LISTS, len(sample) // EACH if lists is None else len(sample)))
        centroids = fit(sample, k, kind) if len(sample) else np.zeros((0, 1))
        dealt = save(_nearest_lists(rows, centroids, kind, 1).drop("turn"), "dealt") if n else rows.withColumn("list", F.lit(0))
        counts = dealt.groupBy("list").agg(F.count("*").alias("n"))
        told = {r["list"]: r["n"] for r in counts.collect()}  # LISTS rows at most
        about = [(i, told.get(i, 0), c.tolist()) for i, c in enumerate(centroids)]
        schema = "list int, n long, centroid array<double>"
        spark.createDataFrame(about, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
        parts = spark.createDataFrame([(i, -(-m // CHUNK) or 1) for i, m, _ in about], "list int, parts int")
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
        # a part is one task's at most, and few files hold a list
        dealt.join(F.broadcast(parts), "list").select("id", "v", part, "list").repartition("list", "part").sortWithinPartitions("list", "part").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
        cls._note(spark, path, {"metric": kind, "probes": max(k, 1), "rows": n, "id": rows.schema["id"].dataType.jsonValue()})
        made = cls(spark, path)
        if k > 1:
            cls._note(spark, path, made.about | {"probes": made.probes_for(recall)})
        return cls(spark, path)

    @staticmethod
    def _note(spark: SparkSession, path: str, about: dict) -> None:
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about.json")

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """All vectors, or those of some lists: the partitions that are read."""
        if not self.about["rows"]:
            return self.spark.createDataFrame([], "id long, v array<double>, part int, list int")
        df = self.spark.read.parquet(f"{self.path}/rows")
        return df if lists is None else df.filter(F.col("list").isin(lists))

    def probes_for(self, recall: float, k: int = 10) -> int:
        """The fewest probes that find ``recall`` of the ``k`` nearest of a sample of the index's own vectors.

        One exact search: a result is found with as many probes as its list comes late among its query's.
        """
        own, lists = self.rows(), len(self.centroids)
        place = F.pmod(F.xxhash64("id", F.lit("probe")), F.lit(1 << 40)) < int(min(1.0, 2.0 * PROBED / max(self.about["rows"], 1)) * (1 << 40))
        asked = save(own.filter(place).orderBy(F.xxhash64("id", F.lit("probe"))).limit(PROBED).select(F.monotonically_increasing_id().alias("query_id"), F.col("v").alias("query")), "probed")
        turns = _nearest_lists(_vectors(asked, "query_id", "query"), self.centroids, self.metric, lists).select(F.col("id").alias("query_id"), "list", "turn")
        exact = self._brute(asked, k).join(own.select("id", "list"), "id")
        found = exact.join(turns, ["query_id", "list"]).groupBy("turn").agg(F.count("*").alias("n")).orderBy("turn").collect()  # LISTS rows at most
        upto, total = 0, sum(r["n"] for r in found)
        for r in found:
            upto += r["n"]
            if upto >= recall * total:
                return r["turn"]
        return lists

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, live: DataFrame | None = None) -> DataFrame:
        """(query_id, id, distance, rank): the ``k`` nearest of each query (query_id, query) among the lists that it probes.

        ``live`` (id) are ids to leave out. Which lists are probed at all is known before the plan is made: LISTS numbers at most.
        """
        probes = min(probes or self.probes, len(self.centroids))
        empty = self.spark.createDataFrame([], T.StructType([queries.schema["query_id"], T.StructField("id", T.StringType()), T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
        if not probes or not self.about["rows"]:
            return empty
        asked = save(_nearest_lists(_vectors(queries, "query_id", "query"), self.centroids, self.metric, probes).drop("turn"), "probes")
        per_list = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
        sizes = dict(zip(self.lists.column("list").to_pylist(), self.lists.column("n").to_pylist(), strict=True))
        plan = [(i, -(-sizes[i] // CHUNK), -(-m // knn.BLOCK)) for i, m in sorted(per_list.items()) if sizes[i]]
        if not plan:
            return empty
        shape = F.broadcast(self.spark.createDataFrame(plan, "list int, parts int, blocks int"))
        held = self.rows([i for i, _, _ in plan])
        held = held if live is None else held.join(sized(live.select("id")), "id", "left_anti")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = held.join(shape, "list").withColumn("block", each("blocks")).select("list", "part", "block", "id", "v")
        right = asked.withColumnsRenamed({"id": "query_id", "v": "query"}).join(shape, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        right = right.withColumn("part", each("parts")).select("list", "part", "block", "query_id", "query")
        schema = T.StructType([queries.schema["query_id"], held.schema["id"], T.StructField("distance", T.DoubleType())])
        found = left.groupBy("list", "part", "block").cogroup(right.groupBy("list", "part", "block")).applyInArrow(knn.scorer(k, self.metric, schema), schema)
        return top(found, k, ["query_id"], F.col("distance"), F.col("id"))

    def _brute(self, queries: DataFrame, k: int) -> DataFrame:
        """The exact ``k`` nearest by brute force over the stored rows, without the lists."""
        rows = self.rows().select("id", F.col("v").alias("embedding"))
        return knn.search(rows, queries, k, self.metric, id_col="id")

    def recall(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> float:
        """The share of the exact ``k`` nearest that a search finds. The exact ones are found by brute force: each query meets every row."""
        exact = save(self._brute(queries, k), "exact")
        return self.search(queries, k, probes).join(exact.select("query_id", "id"), ["query_id", "id"], "left_semi").count() / max(exact.count(), 1)
