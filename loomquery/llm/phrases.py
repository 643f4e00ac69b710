"""11. Benchmark decontamination by a distributed positional inverted index.

``build`` stores the postings of every word of every document: for each segment (an Arrow batch of documents
where they are read) and each of its words, the places where it stands, as rows of a written table. Places count
the segment's words from 0, with one place left free after each document, so that no phrase runs across.

A search takes the words of the tests, reads their postings, and counts each word over all segments. Tests
go to the segments that hold the rarest word of one of their windows. There, list by list from the window's rarest word
on, the places of each word are moved back by its offset in the window and intersected with what is left:
what remains at the end are the window's exact occurrences. ``near`` finds, about the rarest word, the shortest
spans that hold all words of a test in any order.

A segment is bounded by the bytes of a batch, never by how often a word or a passage occurs, and is one group of the
search; tests beyond BLOCK are dealt over further groups of the same segment. Nothing is kept of a word's place
but its number, so a word that a third of all places hold has as many rows as there are segments.

Defined results: null and empty texts have no words: no hits, the digest of the empty string. Test rows that share an id
are one item with several texts; a null id is the item ``null``. Repeated document rows get a row each.
A test without words never occurs; a test of fewer words than a window is one window. Very long texts are taken whole
and make a segment of their own. Only id and text are read, whatever other columns there are. Empty tables: no
documents give no rows, no tests no hits. Order and ties don't matter: results are counts and sorted lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomquery.llm import common as C
from loomquery.llm import postings
from loomquery.plans.ship import ship
from loomquery.plans.tables import sized

#: Words of a window.
WINDOW = 10
#: Tests of a group of a segment.
BLOCK = 20_000


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index as a saved table of three kinds of rows.

    A word's postings: segment, term, n and ``at`` (little-endian 32-bit places); a segment: segment and ``at`` (its
    documents' first places); a document: segment, ord (from 0), doc_id and n_words.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("segment", T.LongType()), T.StructField("term", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("at", T.BinaryType())]
        + [T.StructField("ord", T.LongType()), T.StructField("doc_id", id_type), T.StructField("n_words", T.LongType())]
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        none = lambda n, kind: pa.nulls(n, kind)
        for number, batch in enumerate(batches):
            ids, segment = batch.column(0), postings.segment(number)
            found = postings.words(batch.column(1))
            n, base = len(found.counts), np.concatenate(([0], np.cumsum(found.counts[:-1] + 1)))[: len(found.counts)]
            same = lambda k, s=segment: pa.array(np.full(k, s), pa.int64())
            yield pa.RecordBatch.from_arrays([same(n), none(n, pa.binary()), none(n, pa.int64()), none(n, pa.binary()), pa.array(np.arange(n)), ids, pa.array(found.counts.astype(np.int64))], names=schema.names)
            yield pa.RecordBatch.from_arrays([same(1), none(1, pa.binary()), none(1, pa.int64()), pa.array([base.astype("<u4").tobytes()], pa.binary()), none(1, pa.int64()), none(1, ids.type), none(1, pa.int64())], names=schema.names)
            order = np.argsort(found.codes, kind="stable")
            places = (np.arange(len(found.codes)) + found.rows)[order].astype("<u4")
            edges = np.concatenate(([0], np.cumsum(np.bincount(found.codes, minlength=len(found.terms)))))
            k = len(found.terms)
            yield pa.RecordBatch.from_arrays([same(k), found.terms, pa.array(np.diff(edges)), postings.binaries(places, 4 * edges), none(k, pa.int64()), none(k, ids.type), none(k, pa.int64())], names=schema.names)

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return C.save(rows.mapInArrow(run, schema), "phrases")


def tests(rows: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words): the words of each test row that has some; ``item`` is its id as text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = postings.words(batch.column(1))
            terms = found.terms.take(pa.array(found.codes))
            words = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(found.counts))), pa.int32()), terms)
            yield pa.RecordBatch.from_arrays([batch.column(0), words], names=["item", "words"])

    ship(rows.sparkSession)
    asked = rows.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return asked.mapInArrow(run, "item string, words array<binary>").filter("size(words) > 0").distinct()


def exact(lists: list[np.ndarray]) -> np.ndarray:
    """The places where the words whose places are ``lists`` stand one after another."""
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    left = lists[order[0]] - order[0]
    for i in order[1:]:
        if not len(left):
            break
        at = np.searchsorted(lists[i], left + i)
        left = left[lists[i][np.minimum(at, len(lists[i]) - 1)] == left + i]
    return left


def spans(lists: list[np.ndarray], within: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the shortest spans of at most ``within`` places that hold a place of each list."""
    rare = min(lists, key=len)
    reach = []
    for x in lists:
        # what lies too far from the rarest word is no part of a span
        a = np.searchsorted(rare, x - within + 1)
        reach.append(x[(a < len(rare)) & (rare[np.minimum(a, len(rare) - 1)] < x + within)])
    if not all(len(x) for x in reach):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.unique(np.concatenate(reach))
    ends = starts.copy()
    for x in reach:
        at = np.searchsorted(x, starts)
        ends = np.where(at < len(x), np.maximum(ends, x[np.minimum(at, len(x) - 1)]), np.iinfo(np.int64).max)
    good = ends - starts < within
    starts, ends = starts[good], ends[good]
    shortest = np.append(ends[1:] > ends[:-1], True) if len(ends) else good[:0]
    return starts[shortest], ends[shortest]


def _in_segment(words: list[bytes], places: dict[bytes, np.ndarray], window: int) -> list[tuple[int, int]]:
    """Occurrences (first place, words) of the windows of a test."""
    size, here = min(window, len(words)), np.array([w in places for w in words])
    whole = np.convolve(here, np.ones(size, np.int64), "valid") == size
    out = []
    for i in np.flatnonzero(whole):
        out += [(int(p), size) for p in exact([places[w] for w in words[i : i + size]])]
    return out


def _near_in_segment(words: list[bytes], places: dict[bytes, np.ndarray], within: int, edges: np.ndarray) -> list[tuple[int, int]]:
    """Occurrences (first place, places) of all words of a test together, in one document."""
    terms = sorted(set(words))
    if any(w not in places for w in terms):
        return []
    a, b = spans([places[w] for w in terms], within)
    one = np.searchsorted(edges, a, "right") == np.searchsorted(edges, b, "right")
    return [(int(x), int(y - x + 1)) for x, y in zip(a[one], b[one], strict=True)]


def _search(index: DataFrame, asked: DataFrame, rarest, match: Callable) -> DataFrame:
    """(segment, ord, item, at, n): occurrences by document, from the first word's number in it, over n words.

    ``asked`` has (item, words). ``rarest`` makes, of the array ``ranked`` of (df, word) in the order of words, the array of the words that
    a segment must hold one of; ``match`` finds occurrences in a segment.
    """
    asked = C.save(asked.withColumn("q", F.xxhash64("item", "words")), "tests")
    blocks = -(-asked.count() // BLOCK) or 1
    vocabulary = C.save(asked.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    lists = C.save(index.filter("term is not null").select("segment", "term", "n", "at").join(sized(vocabulary), "term"), "lists")
    df = C.save(lists.groupBy("term").agg(F.sum("n").alias("df")), "counts")
    each = asked.select("q", F.posexplode("words").alias("i", "term")).join(sized(df), "term", "left")
    ranked = each.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("df", F.lit(0)).alias("df"), "term"))).alias("ranked"))
    ranked = ranked.withColumn("ranked", F.transform("ranked", lambda x: F.struct(x["df"].alias("df"), x["term"].alias("term"))))
    need = C.save(ranked.select("q", F.explode(F.array_distinct(rarest)).alias("term")), "rarest")
    where = lists.select("segment", "term").join(sized(need), "term").select("segment", "q").distinct()
    block = F.pmod("q", F.lit(blocks)).cast("int").alias("block")
    candidates = C.save(where.join(sized(asked), "q").select("segment", block, "item", "words"), "candidates")
    heads = index.filter("term is null and at is not null").select("segment", "term", "at")
    held = lists.select("segment", "term", "at").unionByName(heads).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left, right):
        import pyarrow as pa

        at = {t: np.frombuffer(a, "<u4").astype(np.int64) for t, a in zip(left.column("term").to_pylist(), left.column("at").to_pylist(), strict=True)}
        edges, found = at.pop(None, np.zeros(1, np.int64)), []
        for item, words in zip(right.column("item").to_pylist(), right.column("words").to_pylist(), strict=True):
            found += [(p, n, item) for p, n in match(words, at, edges)]
        place, n, item = zip(*found, strict=True) if found else ((), (), ())
        place = np.array(place, dtype=np.int64)
        ord_ = np.searchsorted(edges, place, "right") - 1
        segment = right.column("segment")[0].as_py() if len(right) else 0
        return pa.table({"segment": pa.array(np.full(len(place), segment), pa.int64()), "ord": pa.array(ord_, pa.int64()), "item": pa.array(item, pa.string()), "at": pa.array(place - edges[ord_], pa.int64()), "n": pa.array(n, pa.int64())})

    return held.groupBy("segment", "block").cogroup(candidates.groupBy("segment", "block")).applyInArrow(run, "segment long, ord long, item string, at long, n long")


def occurrences(index: DataFrame, asked: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact occurrences of the windows of ``asked`` (``tests``)."""
    size = F.least(F.size("ranked"), F.lit(window))
    # the rarest word of each window; one without any posting leaves its windows out
    least = F.transform(F.sequence(F.lit(0), F.size("ranked") - size), lambda i: F.array_min(F.slice("ranked", i + 1, size)))
    rarest = F.transform(F.filter(least, lambda x: x["df"] > 0), lambda x: x["term"])
    return _search(index, asked, rarest, lambda words, at, edges: _in_segment(words, at, window))


def near(index: DataFrame, asked: DataFrame, within: int) -> DataFrame:
    """(segment, ord, item, at, n): the shortest spans of at most ``within`` words of a document that hold all words of a test, in any order."""
    least = F.array_min("ranked")
    rarest = F.when(least["df"] > 0, F.array(least["term"])).otherwise(F.array().cast("array<binary>"))
    return _search(index, asked, rarest, lambda words, at, edges: _near_in_segment(words, at, within, edges))


def documents(index: DataFrame) -> DataFrame:
    return index.filter("ord is not null").select("segment", "ord", "doc_id", "n_words")


#: The number of places that spans (first, end), sorted, cover.
_COVERED = """
aggregate(array_sort(collect_set(struct(at, at + n as e))), struct(0L as n, 0L as e), (a, x) -> struct(a.n + greatest(x.e - greatest(x.at, a.e), 0L) as n, greatest(x.e, a.e) as e), a -> a.n)
"""


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_hit (words inside an occurrence), n_items, items (ids as text, sorted), contaminated."""
    index = build(docs, id_col, text_col)
    found = C.save(occurrences(index, tests(benchmark, item_col, item_text_col), window), "occurrences")
    # places first: a place that many items share is told once
    hits = found.groupBy("segment", "ord", "at", "n").agg(F.count("*").alias("_")).groupBy("segment", "ord").agg(F.expr(_COVERED).alias("n_hit"))
    items = found.groupBy("segment", "ord").agg(F.array_sort(F.collect_set("item")).alias("items"))
    told = C.save(hits.join(items, ["segment", "ord"]), "hits")
    out = documents(index).join(sized(told), ["segment", "ord"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(F.col("doc_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def digest(items="items"):
    """The digest of a row's sorted items, comma-joined."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)
