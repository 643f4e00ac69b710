"""Exact and embedding duplicates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomquery.plans.ship import ship
from loomquery.plans.tables import save, sized

#: Vectors of a block of the similarity join.
BLOCK = 2048
#: Blocks of one set of vectors, unless they would have more than LARGEST rows: each row is sent once for each block.
GRID, LARGEST = 16, 65_536
#: Products that a task holds at a time, and how far single precision is trusted (its error on unit vectors of 64 numbers is under 1e-5).
CELLS, MARGIN = 1 << 22, 1e-3


def exact(docs: DataFrame, text_col: str = "text", *order: Column) -> DataFrame:
    """The first document of each text, by md5. The digest, not the text, is what groups are dealt by."""
    first = Window.partitionBy("h").orderBy(*(order or (F.col("doc_id"),)))
    marked = docs.withColumn("h", F.md5(text_col))
    return marked.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "h")


def _products(threshold: float):
    """Of a pair of blocks (columns id, v, own, i, j): the pairs whose cosine similarity reaches ``threshold``.

    Products are made in single precision, CELLS at a time; what comes within MARGIN of the threshold is
    computed again in double precision, and that decides.
    """

    def run(table):
        import pyarrow as pa

        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, ids, v = table.column("own").to_numpy(), table.column("id").to_numpy(), table.column("v").combine_chunks()
        x = np.asarray(v.flatten()).reshape(len(v), -1)
        found = {"id_a": [np.zeros(0, np.int64)], "id_b": [np.zeros(0, np.int64)], "similarity": [np.zeros(0)]}
        unit = {}
        for k in {i, j}:
            part = x[own == k].astype(np.float64)
            size = np.linalg.norm(part, axis=1)
            unit[k] = ids[own == k][size > 0], part[size > 0] / size[size > 0, None]
        (ids_a, a), (ids_b, b) = unit[i], unit[j]
        near = b.astype(np.float32).T
        step = max(1, CELLS // max(1, len(b)))
        for at in range(0, len(a) if len(b) else 0, step):
            p, q = np.nonzero(a[at : at + step].astype(np.float32) @ near >= np.float32(threshold - MARGIN))
            for lo in range(0, len(p), CELLS // 64):
                one, other = p[lo : lo + CELLS // 64] + at, q[lo : lo + CELLS // 64]
                s = np.einsum("nd,nd->n", a[one], b[other])
                keep = (s >= threshold) & ((ids_a[one] < ids_b[other]) if i == j else True)
                one, other = ids_a[one[keep]], ids_b[other[keep]]
                for c, values in zip(found, (np.minimum(one, other), np.maximum(one, other), s[keep]), strict=True):
                    found[c].append(values)
        return pa.table({c: np.concatenate(parts) for c, parts in found.items()})

    return run


def _blocks(n: int, block: int) -> int:
    """Blocks for ``n`` rows: of ``block`` rows, but no more than GRID as long as a block then has at most LARGEST."""
    return max(1, -(-n // LARGEST), min(-(-n // block), GRID))


def _dealt(rows: DataFrame, n: Column) -> DataFrame:
    """``rows`` (id, v) in ``n`` blocks by a hash of the id, each row once for each block that its own one meets."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("id"), n).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("i"), F.greatest(F.col("own"), o).alias("j")))
    return dealt.withColumn("m", F.explode(meets)).select(*rows.columns, "own", "m.i", "m.j")


def similar_pairs(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """(id_a, id_b, similarity): all pairs with cosine similarity of at least ``threshold``, id_a < id_b.

    Vectors are dealt into blocks of ``block`` rows or, of more vectors than GRID blocks take, into GRID larger ones; each pair of
    blocks is one matrix product on an executor that hands back the similar pairs only. A row is shuffled once for each block, so what is
    shuffled grows like the vectors up to GRID * LARGEST of them; a task holds two blocks of at most LARGEST rows or so. All
    pairs are computed, so work grows with the square (``sketched_pairs`` is the way beyond some millions). Null vectors have no pairs.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").alias("v")).filter("v is not null")
    found = _dealt(rows, F.lit(_blocks(rows.count(), block))).groupBy("i", "j").applyInArrow(_products(threshold), "id_a long, id_b long, similarity double")
    return found.select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


def sketched_pairs(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", block: int = BLOCK, sketches: int = 16, bits: int = 8, seed: int = 5) -> DataFrame:
    """The pairs of ``similar_pairs`` that agree on one of ``sketches`` sketches, with their exact similarity.

    A sketch is the signs of ``bits`` random projections. Two vectors at an angle of a agree on one with chance
    (1 - a / pi) ** bits: at a similarity of 0.95, 16 sketches of 8 bits miss one pair in 7,000. Only vectors
    of one bucket are compared; a bucket of more than ``block`` vectors is dealt into blocks like all of them.
    """
    ship(vectors.sparkSession)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def codes(s: pd.Series) -> pd.Series:
        if not len(s):
            return pd.Series([], dtype=object)
        x = np.array(s.tolist(), dtype=np.float64)
        planes = np.random.default_rng(seed).normal(size=(x.shape[1], sketches * bits))
        signs = (x @ planes > 0).reshape(len(x), sketches, bits)
        return pd.Series((signs << np.arange(bits)).sum(axis=2).astype(np.int32).tolist())

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter("v is not null")
    each = save(rows.select("id", "v", codes("v").alias("c")), "sketches").select("id", "v", F.posexplode("c").alias("sketch", "code"))
    sizes = save(each.groupBy("sketch", "code").agg(F.ceil(F.count("*") / block).alias("n")), "buckets")
    paired = _dealt(each.join(sized(sizes), ["sketch", "code"]), F.col("n"))
    found = paired.groupBy("sketch", "code", "i", "j").applyInArrow(_products(threshold), "id_a long, id_b long, similarity double")
    return found.groupBy("id_a", "id_b").agg(F.round(F.max("similarity"), 6).alias("similarity"))


#: Pairs up to which greedy choices are made in one task; of a component, and of all pairs if they are no more.
SETTLED = 1 << 20


def _greedy(df: pd.DataFrame) -> pd.DataFrame:
    """Of pairs (early, id): the ids that go, as an earlier neighbour is kept. Ids are looked at in ascending order."""
    gone: set[int] = set()
    for i, early in df.sort_values(["id", "early"])[["id", "early"]].groupby("id", sort=True)["early"]:
        if any(e not in gone for e in early):
            gone.add(int(i))
    return pd.DataFrame({"id": sorted(gone)}, dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every end of ``edges`` (early, id; saved): the smallest id that it is linked with.

    Every round each id takes the least root of its neighbours, for itself and for the root that it had, and then its root's root:
    roots get near by doubling, so rounds grow with the logarithm of the longest path.
    """
    both = save(edges.select("id", F.col("early").alias("other")).unionByName(edges.select(F.col("early").alias("id"), F.col("id").alias("other"))).distinct(), "both")
    state = save(both.groupBy("id").agg(F.least("id", F.min("other")).alias("root")), "roots")
    while True:
        near = both.join(state.withColumnsRenamed({"id": "other", "root": "r"}), "other").select("id", "r").join(state, "id").select("id", "root", F.least("r", "root").alias("r"))
        told = near.select("id", "r").unionByName(near.select(F.col("root").alias("id"), "r")).groupBy("id").agg(F.min("r").alias("r"))
        jumped = told.join(told.select(F.col("id").alias("r"), F.col("r").alias("root")), "r", "left").select("id", F.least("root", "r").alias("root"))
        new = save(jumped, "roots")
        same = new.join(state.withColumnRenamed("root", "old"), "id").filter("root <> old").isEmpty()
        state = new
        if same:
            return state


def _rounds(edges: DataFrame) -> DataFrame:
    """The ids that go, by rounds: each settles the vectors whose earlier neighbours are all settled."""
    state = save(edges.select("id").distinct().withColumn("kept", F.lit(None).cast("boolean")), "greedy")
    while True:
        # an earlier vector without earlier neighbours of its own is kept from the start
        listed = state.select(F.col("id").alias("early"), F.lit(True).alias("listed"), "kept")
        of_early = edges.join(listed, "early", "left").select("id", F.when(F.col("listed").isNull(), True).otherwise(F.col("kept")).alias("kept"))
        seen = of_early.groupBy("id").agg(F.max(F.col("kept").cast("int")).alias("any"), F.sum(F.col("kept").isNull().cast("int")).alias("open"))
        new = save(seen.select("id", F.when(F.col("any") == 1, False).when(F.col("open") == 0, True).alias("kept")), "greedy", replaces=state)
        if new.filter("kept is null").isEmpty():
            return new.filter("not kept").select("id")
        state = new


def by_embedding(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", pairs: Callable[..., DataFrame] = similar_pairs) -> DataFrame:
    """``vectors`` without those similar to an earlier one that is kept (greedy in order of id).

    ``pairs`` finds the similar ones: ``similar_pairs`` or ``sketched_pairs``. Vectors of different components don't touch each other's
    choice: a component of up to SETTLED pairs is settled in one task (and all of them, if there are no more pairs than that); only
    larger ones take rounds, as many as their longest chain.
    """
    edges = save(pairs(vectors, threshold, id_col).select(F.col("id_a").alias("early"), F.col("id_b").alias("id")), "similar")
    ship(vectors.sparkSession)
    if edges.count() <= SETTLED:
        gone = edges.groupBy().applyInPandas(_greedy, "id long")
    else:
        rooted = save(edges.join(components(edges), "id"), "rooted")
        large = save(rooted.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > SETTLED).select("root"), "large")
        gone = rooted.join(sized(large), "root", "left_anti").groupBy("root").applyInPandas(_greedy, "id long")
        if not large.isEmpty():
            gone = gone.unionByName(_rounds(save(rooted.join(sized(large), "root", "left_semi").select("early", "id"), "chained")))
    return vectors.join(gone.withColumnRenamed("id", id_col), id_col, "left_anti")
