"""Connected components of a graph whose edges and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm import common as C


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every node of ``edges`` (columns a, b): root is the component's smallest node.

    Each round every node hooks its parent, and itself, to the smallest parent among its neighbours, and
    then takes its grandparent for parent. Paths halve, so rounds grow with the logarithm of a component's
    width. A round moves edges and one row per node, pre-aggregated by node, and ends in a written table that
    replaces the last round's. No edges: no rows.
    """
    both = C.save(edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select("b", "a")).filter("v <> u").distinct(), "edges")
    state = C.save(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("p")), "parents")
    while True:
        state_of = state.select("v", "p")
        near = both.join(state.select(F.col("v").alias("u"), F.col("p").alias("q")), "u").groupBy("v").agg(F.min("q").alias("m"))
        seen = state_of.join(near, "v")
        hooks = seen.select("v", F.least("p", "m").alias("p")).union(seen.select(F.col("p").alias("v"), F.col("m").alias("p")))
        hooked = hooks.groupBy("v").agg(F.min("p").alias("p"))
        after = hooked.join(hooked.select(F.col("v").alias("p"), F.col("p").alias("pp")), "p").select("v", F.least("p", "pp").alias("p"))
        told = after.join(state.withColumnRenamed("p", "old").select("v", "old"), "v").select("v", "p", (F.col("p") != F.col("old")).alias("moved"))
        state = C.save(told, "parents", replaces=state)
        if state.filter("moved").isEmpty():
            return state.select("v", F.col("p").alias("root"))


def contracted_components(edges: DataFrame) -> DataFrame:
    """The same as ``components``, for dense graphs.

    Every node first merges with its smallest neighbour (a grouped minimum). Edges, taken in one direction
    only, are then told between merged nodes; those inside a merged node and repeats fall away, so the
    rounds see few of them.
    """
    one = C.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    ends = one.select(F.col("a").alias("v"), F.col("a").alias("p")).union(one.select(F.col("b").alias("v"), F.col("a").alias("p")))
    merged = C.save(ends.groupBy("v").agg(F.min("p").alias("p")), "merged")
    side = lambda c: merged.select(F.col("v").alias(c), F.col("p").alias(f"p{c}"))
    between = one.join(side("a"), "a").join(side("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).filter("a <> b").distinct()
    roots = components(C.save(between, "between"))
    return merged.join(roots.withColumnRenamed("v", "p"), "p", "left").select("v", F.coalesce("root", "p").alias("root"))
