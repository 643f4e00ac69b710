"""12. Ranked lexical search over a bit-sliced impact index.

An impact says what a word adds to a document's score before the word's own weight: an integer that grows with the
word's count in the document and falls with the document's length. ``build`` stores, for each segment (an Arrow
batch of documents, by ascending id) and each word, which documents hold it and its impacts *by slice*: for each bit
of the impact a bitmap over these documents.

``search`` reads the postings of the queries' words, sums their document frequencies over all segments and takes each
word's weight from them. In a segment, a query's scores are a stack of bitmaps over the segment's documents, one for
each bit of the score: for each word and each bit of its weight the impact slices, moved up by that bit, are added by
bitwise carry arithmetic (sum = a ^ b ^ carry), 64 documents at a time and all queries of a block together. The
best k are found from the most significant slice down: documents with the bit set either fill up the best ones, or,
if they are more than k, are all that is looked at further; the ids decide what is equal to the end. The k best
of each segment meet in a window with group limit, partial before its shuffle.

Segments are bounded by a batch's bytes and rows and queries are dealt in blocks, so a task holds bitmaps of bounded
size whatever the word. A word that all documents hold has one row a segment.

Defined results: null texts, and texts without a word, have no terms, count nowhere and are never found. Query rows of
one id and text count once; texts of one id are one query; a null id is an id. Words that no document holds add
nothing. Repeated document rows are ranked each; equal scores go by ascending id (nulls last). Very long texts are taken
whole, in a segment of their own. Only id and text are read, whatever other columns there are. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomquery.llm import common as C
from loomquery.llm import postings
from loomquery.plans.ship import ship
from loomquery.plans.tables import row_numbers, sized, top

#: The scale of impacts; the numerator of a document's own part, and its weight in it in hundredths.
SCALE, NORM, B = 1000, 12, 25
#: Bits of an impact: it is under SCALE * SCALE.
SLICES = 20
#: Queries that a group of a segment scores together.
BLOCK = 256


def _slices(x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of numbers under 2**SLICES, by word (between each two edges) and slice, each slice in whole bytes; and where words start."""
    n = np.diff(edges)
    width = -(-n // 8)
    starts = np.concatenate(([0], np.cumsum(SLICES * width)))
    rank = np.arange(len(x)) - np.repeat(edges[:-1], n)
    heads = np.flatnonzero(rank % 8 == 0)
    place, step = (np.repeat(starts[:-1], n) + rank // 8)[heads], np.repeat(width, n)[heads]
    out = np.zeros(starts[-1], np.uint8)
    for s in range(SLICES if len(x) else 0):
        out[place + s * step] = np.add.reduceat((x >> s & 1) << (rank % 8), heads)
    return out, starts


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The index as a saved table, and the number of documents with a word.

    A word's postings: segment, term, n, ``docs`` (little-endian 32-bit numbers in the segment) and ``slices``; a segment: segment and ``ids``.
    """
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ship(docs.sparkSession)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n = postings.counts(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["n", "words"])

    total = rows.select("text").mapInArrow(count, "n long, words long").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    n_docs, n_words = total["n"] or 0, total["words"] or 1
    schema = T.StructType(
        [T.StructField("segment", T.LongType()), T.StructField("term", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("docs", T.BinaryType())]
        + [T.StructField("slices", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type))]
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for number, batch in enumerate(batches):
            batch = batch.take(pc.array_sort_indices(batch.column(0)))  # nulls last
            ids, found = batch.column(0), postings.words(batch.column(1))
            pairs, tf = np.unique(found.codes * len(ids) + found.rows, return_counts=True)
            terms, rows_ = np.divmod(pairs, max(len(ids), 1))
            norm = 100 - B + B * found.counts.astype(np.int64) * n_docs // n_words
            x = SCALE**3 * tf // (SCALE * tf + NORM * norm[rows_])
            k = len(found.terms)
            edges = np.concatenate(([0], np.cumsum(np.bincount(terms, minlength=k))))
            bits, starts = _slices(x, edges)
            segment = postings.segment(number)
            same = lambda n, s=segment: pa.array(np.full(n, s), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            nothing = [pa.nulls(1, t) for t in (pa.binary(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([same(1), *nothing, lists], names=schema.names)
            yield pa.RecordBatch.from_arrays(
                [same(k), found.terms, pa.array(np.diff(edges)), postings.binaries(rows_.astype("<u4"), 4 * edges), postings.binaries(bits, starts), pa.nulls(k, lists.type)], names=schema.names
            )

    return C.save(rows.mapInArrow(run, schema), "impacts"), n_docs


def add(total: np.ndarray, part: np.ndarray, at: int) -> None:
    """Add the number whose slices are ``part`` (bit by bit) to the one of ``total``, moved up by ``at`` bits: a ripple of carries."""
    carry = np.zeros_like(total[0])
    for s in range(at, len(total)):
        a = total[s]
        if s - at < len(part):
            b = part[s - at]
            either = a ^ b
            total[s], carry = either ^ carry, a & b | either & carry
        elif carry.any():
            total[s], carry = a ^ carry, a & carry
        else:
            break


def best(total: np.ndarray, k: int) -> np.ndarray:
    """Bitmaps of the k best documents with a score above zero: of each row of ``total`` (slice, row, 64 documents a number). Equal ones go by place."""
    sure = np.zeros_like(total[0])
    open_ = np.bitwise_or.reduce(total, axis=0)
    for s in range(len(total) - 1, -1, -1):
        more = sure | open_ & total[s]
        n = np.bitwise_count(more).sum(axis=1, dtype=np.int64)[:, None]
        # over k: the rest is out; else those with the bit are in, and the others stay open
        sure, open_ = np.where(n > k, sure, more), np.where(n > k, open_ & total[s], open_ & ~total[s])
    missing = k - np.bitwise_count(sure).sum(axis=1, dtype=np.int64)
    for row in np.flatnonzero((missing > 0) & open_.any(axis=1)):
        tied = np.unpackbits(open_[row].view(np.uint8), bitorder="little")
        tied[np.flatnonzero(tied)[missing[row] :]] = 0
        sure[row] |= np.packbits(tied, bitorder="little").view(np.uint64)
    return sure


def _spread(docs: np.ndarray, bits: bytes, words: int) -> np.ndarray:
    """A word's slices as bitmaps over all documents of the segment."""
    packed = np.frombuffer(bits, np.uint8).reshape(SLICES, -1)
    out = np.zeros((SLICES, 64 * words), np.uint8)
    out[:, docs] = np.unpackbits(packed, axis=1, bitorder="little")[:, : len(docs)]
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def scores(n_docs: int, lists: list[tuple[np.ndarray, bytes, list[tuple[int, int]]]], k: int) -> Iterator[tuple[int, int, int]]:
    """(query, document, score) of the k best of each query in a segment.

    ``lists`` has, for each word, its documents, its slices, and the (query, weight) pairs that use it.
    """
    by: dict[int, list[tuple[int, int]]] = {}
    for i, (_, _, uses) in enumerate(lists):
        for q, w in uses:
            by.setdefault(q, []).append((i, w))
    queries, words = sorted(by), -(-n_docs // 64)
    # a sum is under SCALE**2 times the sum of its weights
    height = max((SCALE**2 * sum(w for _, w in of) for of in by.values()), default=0).bit_length()
    total = np.zeros((height, len(queries), words), np.uint64)
    for turn in range(max(map(len, by.values()), default=0)):
        rows = [r for r, q in enumerate(queries) if len(by[q]) > turn]
        parts = np.stack([_spread(lists[by[queries[r]][turn][0]][0], lists[by[queries[r]][turn][0]][1], words) for r in rows], axis=1)
        weights = np.array([by[queries[r]][turn][1] for r in rows], dtype=np.int64)
        sums = total[:, rows]
        for bit in range(int(weights.max()).bit_length()):
            on = np.flatnonzero(weights >> bit & 1)
            if len(on):
                some = sums[:, on]
                add(some, parts[:, on], bit)
                sums[:, on] = some
        total[:, rows] = sums
    if not queries:
        return
    chosen = best(total, k)
    for row, q in enumerate(queries):
        docs = np.flatnonzero(np.unpackbits(chosen[row].view(np.uint8), bitorder="little"))
        bits = total[:, row, docs >> 6] >> (docs & 63).astype(np.uint64) & np.uint64(1)
        for d, column in zip(docs.tolist(), bits.T.tolist(), strict=True):
            yield q, d, sum(b << s for s, b in enumerate(column))


def weight(n_docs: int, df: str = "df"):
    return F.floor(F.lit(1000.0) * F.ln(F.lit(float(2 * n_docs + 2)) / (2 * F.col(df) + 1).cast("double"))).cast("long")


def search(index: DataFrame, n_docs: int, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k best documents of each query: its id, rank (from 1), doc_id, score."""
    id_type = index.schema["ids"].dataType.elementType
    asked = C.save(queries.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).distinct(), "asked")
    numbered = C.save(row_numbers(asked.select("item").distinct(), F.col("item"), name="q").withColumn("q", F.col("q") - 1), "queries")
    blocks = -(-numbered.count() // BLOCK) or 1

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = postings.words(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found.rows)), found.terms.take(pa.array(found.codes))], names=["q", "term"])

    # an item's words, each with its repeats
    by_id = asked.join(numbered.withColumnRenamed("item", "own"), F.col("item").eqNullSafe(F.col("own"))).select("q", "text")
    terms = C.save(by_id.mapInArrow(cut, "q long, term binary").groupBy("q", "term").agg(F.count("*").alias("repeats")), "terms")
    vocabulary = C.save(terms.select("term").distinct(), "vocabulary")
    lists = C.save(index.filter("term is not null").select("segment", "term", "n", "docs", "slices").join(sized(vocabulary), "term"), "lists")
    df = lists.groupBy("term").agg(F.sum("n").alias("df"))
    weighed = terms.join(df, "term").withColumn("w", weight(n_docs) * F.col("repeats")).filter("w > 0")
    block = F.floor(F.col("q") / BLOCK).cast("int").alias("block")
    uses = C.save(weighed.groupBy("term", block).agg(F.collect_list(F.struct("q", "w")).alias("uses")), "uses")
    held = lists.drop("n").join(sized(uses), "term").withColumn("ids", F.lit(None).cast(T.ArrayType(id_type)))
    heads = index.filter("term is null").select("segment", "ids").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    together = held.unionByName(heads, allowMissingColumns=True).select("segment", "block", "docs", "slices", "uses", "ids")
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])

    def run(table):
        import pyarrow as pa

        head = table.filter(table.column("ids").is_valid()).column("ids")
        ids = head.combine_chunks().flatten()
        rest = table.filter(table.column("docs").is_valid()).select(["docs", "slices", "uses"]).to_pylist()
        lists = [(np.frombuffer(r["docs"], "<u4"), r["slices"], [(u["q"], u["w"]) for u in r["uses"]]) for r in rest]
        found = list(scores(len(ids), lists, k))
        q, d, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"q": pa.array(q, pa.int64()), "doc_id": ids.take(pa.array(d, pa.int64())), "score": pa.array(s, pa.int64())})

    found = together.groupBy("segment", "block").applyInArrow(run, schema)
    ranked = top(found, k, ["q"], F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return ranked.join(sized(numbered), "q").select(F.col("item").alias(id_col), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
