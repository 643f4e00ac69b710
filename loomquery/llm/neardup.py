"""2. SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint has a bit for each of 64 positions, set if over half of its 4-word shingles' XXH64
values (seed 42) have it set. Two fingerprints link at RADIUS or fewer differing bits; components of links
are the near-duplicate groups.

Fingerprints are cut into ``m`` blocks; two that differ in at most 4 bits agree on some m - 4 of them, so
they meet in the bucket of one choice of m - 4 blocks, where the Hamming distance is verified. ``m`` grows
with the number of distinct fingerprints so that a bucket holds about one chance neighbour at most; every
``m`` finds all links. Only distinct fingerprints are joined: exact copies never make pairs.

A cloud of very many near copies would still fill single buckets. Fingerprints in any bucket of more than
HOT members are therefore linked to each other another, linear way: if two differ in at most 4 bits, some
value lies within 2 bits of both, so each names the 2081 values within 2 bits of itself and every value's
namers join its smallest one (they differ from it by 4 bits at most: these are links too). Links with a
fingerprint outside that set lie in small buckets. So no link is lost and no group emits its pairs.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other. Texts under four
words hash their whole word sequence. component_id is the smallest non-null doc_id of the component, null
if there is none. Ids keep their type. Repeated rows get a row each and share a component. Very long texts are
taken whole, in memory a few times their size. Other columns pass through ``drop_near_duplicates``, whatever
their names (but for the prefix ``_lq_``). Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomquery.llm import common as C
from loomquery.llm.graph import contracted_components
from loomquery.plans.ship import ship

SHINGLE, SEED, RADIUS = 4, 42, 4
#: A bucket of more members is split by the linear way.
HOT = 1024
#: Shingles whose hashes are held at a time.
VOTED = 16_384


def simhash(raw: bytes) -> int:
    """The fingerprint of a UTF-8 text as an unsigned integer."""
    from xxhash import xxh64_intdigest

    joined = b" ".join(raw.lower().split())  # of bytes: A-Z, and exactly the ASCII white space
    if not joined:
        return 0
    # places before each word and after the last; numbers only, so that a very long text takes a few times its own size
    edges = np.concatenate(([-1], np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), [len(joined)]))
    k = min(SHINGLE, len(edges) - 1)
    n, counts = len(edges) - k, np.zeros(64, dtype=np.int64)
    for at in range(0, n, VOTED):
        part = zip((edges[at : min(at + VOTED, n)] + 1).tolist(), edges[at + k : min(at + VOTED, n) + k].tolist(), strict=True)
        h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in part), dtype="<u8", count=min(VOTED, n - at))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) of every row, fp as a signed long. Ids keep their type."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            values = [simhash(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(2)]
            fp = pa.array(np.array(values, dtype="<u8").view("<i8"), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp], names=schema.names)

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(C.text_of(text_col)).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(m: int, radius: int = RADIUS) -> list[int]:
    """A mask for each choice of m - radius of m blocks of 64 bits."""
    edges = [64 * i // m for i in range(m + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [reduce(int.__or__, c) for c in combinations(block, m - radius)]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """The fewest blocks whose shared ones hold at least as many bits as number ``n`` fingerprints."""
    m = radius + 2
    while 64 * (m - radius) // m < n.bit_length() and comb(m + 1, radius) <= 1000:
        m += 1
    return m


def linked(fps: DataFrame, n: int, radius: int = RADIUS, hot: int = HOT, count: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Edges (a, b) that join exactly the pairs-reachable fingerprints of ``fps`` (distinct, saved; column fp).

    With ``count`` (``fps`` has a weight w, a number of rows, beside fp) also (fp, n_links): for each fingerprint
    with some, the sum of the weights of all others within the radius.
    """
    masks = [_signed(x) for x in block_masks(blocks_for(n, radius), radius)]
    choices = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(x).alias("mask")) for c, x in enumerate(masks)])
    rows = fps.select(*fps.columns, F.explode(choices).alias("x")).select(*fps.columns, F.col("x.c").alias("c"), F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"))
    full = C.save(rows.groupBy("c", "key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("c", "key"), "hot")
    some = not full.isEmpty()
    cold = rows.join(full, ["c", "key"], "left_anti") if some else rows
    cloud = C.save(rows.join(full, ["c", "key"], "left_semi").select(*fps.columns).distinct(), "cloud") if some else None
    if count:
        inside = cloud.select("fp", F.lit(True).alias("inside")) if some else None
        cold = cold.join(inside, "fp", "left") if some else cold.withColumn("inside", F.lit(None).cast("boolean"))
    other = cold.withColumnsRenamed({"fp": "b", "w": "wb", "inside": "inside_b"})
    apart = F.col("fp").bitwiseXOR(F.col("b"))
    # a pair is told once, by the first choice of blocks that it agrees on
    first = F.forall(F.slice(F.array(*[F.lit(x) for x in masks]), F.lit(1), F.col("c")), lambda x: apart.bitwiseAND(x) != 0)
    pairs = cold.join(other, ["c", "key"]).filter((F.col("fp") < F.col("b")) & (F.bit_count(apart) <= radius) & first)
    if not count:
        pairs = pairs.select(F.col("fp").alias("a"), "b")
        return (pairs.unionByName(_cloud(cloud)) if some else pairs), None
    pairs = C.save(pairs.select(F.col("fp").alias("a"), "b", "w", "wb", F.coalesce(F.col("inside") & F.col("inside_b"), F.lit(False)).alias("inside")), "pairs")
    # pairs inside the cloud are counted there, all of them
    told = pairs.filter(~F.col("inside"))
    parts = told.groupBy(F.col("a").alias("fp")).agg(F.sum("wb").alias("n")).unionByName(told.groupBy(F.col("b").alias("fp")).agg(F.sum("w").alias("n")))
    parts = parts.unionByName(_cloud_counts(cloud)) if some else parts
    counts = parts.groupBy("fp").agg(F.sum("n").alias("n_links"))
    edges = pairs.select("a", "b")
    return (edges.unionByName(_cloud(cloud.select("fp"))) if some else edges), counts


def links(fps: DataFrame, n: int, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """The edges of ``linked``."""
    return linked(fps.select("fp"), n, radius, hot)[0]


def _around(fps: DataFrame) -> DataFrame:
    """``fps`` with the 2081 values within two bits of each fp, and their distance."""
    one = [_signed(1 << i) for i in range(64)]
    bits = F.array(*[F.lit(x) for x in one])
    upper = F.array(*[F.lit(x) for x in [0, *one]])
    lower = F.explode(F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: F.struct(i.alias("i"), F.element_at(upper, i + 1).alias("x"))))
    single = fps.repartition("fp").select(*fps.columns, lower.alias("p"))
    # bits above the first one flipped: the second flip, or none
    second = F.explode(F.concat(F.array(F.lit(0).cast("long")), F.slice(bits, F.col("p.i") + 1, F.when(F.col("p.i") > 0, 64 - F.col("p.i")).otherwise(0))))
    both = single.select(*fps.columns, second.alias("y"), F.col("p.x").alias("x"))
    off = (F.col("x") != 0).cast("int") + (F.col("y") != 0).cast("int")
    return both.select(*fps.columns, F.col("fp").bitwiseXOR(F.col("x")).bitwiseXOR(F.col("y")).alias("value"), off.alias("off"))


def _cloud(fps: DataFrame) -> DataFrame:
    """Edges among fingerprints by shared values within half the radius; linear in their number."""
    # a value is named by the 2081 fingerprints around it at most, so no window is larger
    least = _around(fps.select("fp")).withColumn("a", F.min("fp").over(Window.partitionBy("value")))
    return least.filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def _cloud_counts(fps: DataFrame) -> DataFrame:
    """(fp, n): the weights of the others within four bits, without a pair of them; linear in their number.

    Every value sums the weights of the fingerprints 0, 1 and 2 bits away (s0, s1, s2). A fingerprint reads
    the weight at 1 and 2 bits off its own value. One at 3 bits shares 3 of the values that are 1 bit off
    here and 2 there, one at 1 bit shares 63 of them; one at 4 bits shares 6 of the values that are 2 bits
    off both, one at 2 bits 124 of them, the fingerprint itself all 2016. So the sums over those values give
    the weights at 3 and at 4 bits.
    """
    by = Window.partitionBy("value")
    near = _around(fps).withColumns({f"s{d}": F.sum(F.when(F.col("off") == d, F.col("w")).otherwise(0)).over(by) for d in range(3)})
    at = lambda d, s: F.sum(F.when(F.col("off") == d, F.col(s)).otherwise(0))
    sums = near.groupBy("fp").agg(at(0, "s0").alias("d0"), at(0, "s1").alias("d1"), at(0, "s2").alias("d2"), at(1, "s2").alias("t3"), at(2, "s2").alias("t4"))
    return sums.select("fp", F.expr("d1 + d2 + (t3 - 63 * d1) div 3 + (t4 - 2016 * d0 - 124 * d2) div 6").alias("n"))


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Saved (doc_id, text_hash, fp) rows, and (fp, root) of each distinct fingerprint."""
    rows = C.save(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = C.save(rows.select("fp").distinct(), "distinct")
    roots = contracted_components(C.save(links(distinct, distinct.count()), "links"))
    named = distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return rows, C.save(named, "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id."""
    rows, roots = _grouped(docs, id_col, text_col)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = C.save(roots.join(least, "fp"), "named")
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = C.save(C.spread_join(named, of_root, ["root"], F.col("fp")).select("fp", "component_id"), "groups")
    out = C.spread_join(rows, of_fp, ["fp"], F.struct("doc_id", "text_hash"))
    return out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _key(doc_id, text_hash):
    return F.concat_ws("|", text_hash.cast("string"), C.key_of(doc_id))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (nulls last), then the smallest text hash, then (of rows
    that share both and differ elsewhere) the smallest digest of all columns, so that reruns keep the same row.

    Only keys are sorted out: the rows that go, and those that stay once of several equal ones, are looked up
    where texts are read. Texts move only if these are too many to broadcast, and then in one exchange.
    """
    rows, roots = _grouped(docs, id_col, text_col)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    named = C.save(C.spread_join(rows, roots, ["fp"], F.struct("doc_id", "text_hash")).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")), "named")
    best = named.groupBy("root").agg(F.min(place).alias("best"))
    judged = C.spread_join(named, best, ["root"], F.struct("doc_id", "text_hash")).withColumn("goes", ~place.eqNullSafe(F.col("best")))
    marks = C.save(judged.filter("goes or n > 1").select(_key(F.col("doc_id"), F.col("text_hash")).alias("_lq_key"), F.col("goes").alias("_lq_goes")), "marks")
    keyed = docs.withColumn("_lq_key", _key(F.col(id_col), F.xxhash64(C.text_of(text_col))))
    found = C.lookup(keyed, marks, "_lq_key", F.monotonically_increasing_id())
    alone = found.filter("_lq_goes is null").select(*docs.columns)
    several = marks.filter("not _lq_goes")
    if several.isEmpty():
        return alone
    # rows that share id and text: one of them stays, whatever their order (the rest of a group goes before its exchange)
    whole = F.sha2(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}), 256)
    equal = C.lookup(keyed, several, "_lq_key", F.monotonically_increasing_id(), "inner").withColumn("_lq_n", F.row_number().over(Window.partitionBy("_lq_key").orderBy(whole)))
    return alone.unionByName(equal.filter("_lq_n = 1").select(*docs.columns))
