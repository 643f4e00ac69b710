"""Splitters: one document to many chunks.

Splits that SQL can state are plans of arrays and windows; the recursive ones fold over pieces in Python,
Arrow batch by Arrow batch, one array of chunks a row.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomquery.functions import vector as V
from loomquery.functions.text import strip
from loomquery.plans.ship import ship

#: Separators of the recursive splitter, in the order in which they are tried.
SEPARATORS = (r"\n\n", r"\n", r"。|！|？", r"\.\s|\!\s|\?\s", r"；|;\s", r"，|,\s")
SIZE, OVERLAP = 500, 50
#: What may stand before a full stop that ends no sentence: an initial or an abbreviation.
ABBREVIATIONS = r"(?<!\b\p{Lu})(?<!\b(?:Mr|Ms|Dr|St|vs|No))(?<!\b(?:Mrs|etc|cf|Inc|Ltd))(?<!\b(?:e\.g|i\.e|Prof))"


def _pieces(text: str, separator: str) -> list[str]:
    """The text cut after every match of ``separator``; no empty pieces."""
    ends = [m.end() for m in re.finditer(separator, text)] if separator else range(1, len(text))
    cuts = [0, *ends, len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _windows(pieces: Iterable[str], size: int, overlap: int) -> list[str]:
    """Pieces joined up to ``size``; each window starts with at most ``overlap`` characters of the last."""
    done, held, total = [], deque(), 0
    for p in pieces:
        if held and total + len(p) > size:
            done.append("".join(held).strip())
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.popleft())
        held.append(p)
        total += len(p)
    done.append("".join(held).strip())
    return [w for w in done if w]


def split_recursively(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of one text. A piece that no separator makes smaller is kept whole, however long."""

    def walk(part: str, left: Sequence[str]) -> list[str]:
        at = next((i for i, s in enumerate(left) if re.search(s, part)), len(left) - 1)
        rest, out, small = left[at + 1 :], [], []
        for p in _pieces(part, left[at]):
            if len(p) < size:
                small.append(p)
                continue
            out += _windows(small, size, overlap)
            small = []
            out += walk(p, rest) if rest else [p]
        return out + _windows(small, size, overlap)

    chunks = (re.sub(r"\n{2,}", "\n", c.strip()) for c in walk(text, separators)) if text else ()
    return [c for c in chunks if c.strip()]


def split_markdown_by_size(text: str, size: int = SIZE) -> list[str]:
    """Lines gathered until, before a line that isn't blank, they have ``size`` characters (line ends included).

    From the first header of the text on, twice that. Chunks are as they stand, blank lines included.
    """
    chunks, lines, length, limit = [], [], -1, size
    for line in text.split("\n"):
        if line.strip():
            if re.match(r"#{1,6}\s+.", line.strip()):
                limit = 2 * size
            if lines and length >= limit:
                chunks.append("\n".join(lines))
                lines, length = [], -1
        lines.append(line)
        length += len(line) + 1
    return [*chunks, "\n".join(lines)]


def chunker(split: Callable[[str], list[str]]):
    """A pandas UDF from a function of one text to its chunks: the extension point for splitters of one's own."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split(t) if t else [])

    return run


def explode_chunks(docs: DataFrame, chunks: Column) -> DataFrame:
    """A row for each chunk, with chunk_index, total_chunks and every other column of its own document."""
    rows = docs.withColumn("chunks", chunks).withColumn("total_chunks", F.size("chunks"))
    return rows.select(*[c for c in docs.columns if c != "text"], "total_chunks", F.posexplode("chunks").alias("chunk_index", "text"))


#: Characters of chunks that a task gathers before it hands them back: what it holds follows this, not the number of rows.
HELD = 1 << 20


def _chunked(docs: DataFrame, split: Callable[[str], list], fields: list[T.StructField], values: Callable[[list], Iterable[tuple]]) -> DataFrame:
    """Rows of ``docs``, each once for every tuple that ``values`` makes of its text's chunks, with these as ``fields`` in place of the text.

    Rows go back as soon as they hold HELD characters, in the middle of a batch or of a text.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*[docs.schema[c] for c in kept], *fields])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            of_rows = batch.select(list(range(len(kept))))
            texts, at, out, held = batch.column(len(kept)), [], [], 0

            def made(of_rows=of_rows):
                columns = zip(*out, strict=True)
                types = [pa.int32() if f.dataType == T.IntegerType() else pa.string() if f.dataType == T.StringType() else pa.list_(pa.string()) for f in fields]
                return pa.RecordBatch.from_arrays([c.take(pa.array(at)) for c in of_rows.columns] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

            for i in range(batch.num_rows):
                text = texts[i].as_py()
                for row in values(split(text)) if text else ():
                    at.append(i)
                    out.append(row)
                    held += sum(len(v) if isinstance(v, str) else sum(map(len, v)) if isinstance(v, list) else 1 for v in row)
                    if held >= HELD:
                        yield made()
                        at.clear(), out.clear()
                        held = 0
            if out:
                yield made()

    return docs.select(*kept, "text").mapInArrow(run, schema)


_INDEX, _TEXT = T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType())


def _exploded(docs: DataFrame, split: Callable[[str], list[str]]) -> DataFrame:
    """``explode_chunks`` of a function of one text."""
    numbered = lambda chunks: ((len(chunks), i, c) for i, c in enumerate(chunks))
    return _chunked(docs, split, [T.StructField("total_chunks", T.IntegerType()), _INDEX, _TEXT], numbered)


def recursive(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    return _exploded(docs, lambda t: split_recursively(t, size, overlap, separators))


def markdown(docs: DataFrame, size: int = SIZE) -> DataFrame:
    return _exploded(docs, lambda t: split_markdown_by_size(t, size))


def parent_child(docs: DataFrame, parent: tuple[int, int] = (1500, 150), child: tuple[int, int] = (200, 20)) -> DataFrame:
    """Children of recursively split parents: parent_index, parent_content, child_index, text."""
    fields = [T.StructField("parent_index", T.IntegerType()), T.StructField("parent_content", T.StringType()), T.StructField("children", T.ArrayType(T.StringType()))]
    family = lambda chunks: ((i, c, split_recursively(c, *child)) for i, c in enumerate(chunks))
    cut = _chunked(docs, lambda t: split_recursively(t, *parent), fields, family)
    return cut.select(*[c for c in cut.columns if c != "children"], F.posexplode("children").alias("child_index", "text"))


def parents(children: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, parent_index, parent_content, child_count): each parent of some children once."""
    # counted by hash with the text as a part of the key: a task holds each parent once, and doesn't sort a copy for each child
    each = children.groupBy(key, "parent_index", "parent_content").agg(F.count("*").alias("n"))
    return each.groupBy(key, "parent_index").agg(F.min("parent_content").alias("parent_content"), F.sum("n").alias("child_count"))


def lines(docs: DataFrame) -> DataFrame:
    kept = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return docs.select("doc_id", F.posexplode(kept).alias("line_index", "line"))


def sentence_array(c: Column) -> Column:
    """Sentences, each with its closing mark: cut after 。！？；?!. and following white space."""
    marked = F.regexp_replace(c, r"([。！？；?!.])[ \t\n\x0B\f\r]*", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda x: x != "")


def sentences(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(sentence_array(F.col("text"))).alias("sentence_index", "sentence"))


def cjk_sentences(docs: DataFrame) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", "[。！？；]"), strip), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(parts).alias("sentence_index", "sentence"))


def english_sentences(docs: DataFrame) -> DataFrame:
    """Cut after a full stop, question or exclamation mark (closing quotes included) before white space and a capital, digit or quote.

    Initials and common abbreviations don't end a sentence.
    """
    marked = F.regexp_replace("text", ABBREVIATIONS + r"([.!?]+[\"'”’)\]]*)[ \t\n\x0B\f\r]+(?=[\p{Lu}\p{N}\"'“‘(\[])", "$1\u0001")
    parts = F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(parts).alias("sentence_index", "sentence"))


def groups_of_sentences(docs: DataFrame, buffer: int = 1) -> DataFrame:
    """Chunks of 2 * buffer sentences."""
    n = 2 * buffer
    grouped = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("s") / n) - 1, F.lit(0)).cast("int")), lambda i: F.array_join(F.slice("s", i * n + 1, n), "\n"))
    rows = docs.select("doc_id", sentence_array(F.col("text")).alias("s")).filter(F.size("s") > 0)
    return rows.select("doc_id", F.posexplode(grouped).alias("chunk_index", "text"))


def headers(docs: DataFrame) -> DataFrame:
    """Sections at Markdown headers: section (0 before the first), header, path, text. Inside the row, no shuffle.

    ``path`` is the array of the headers that a section stands under, its own included: a header closes those
    of its level and below. Only levels and headers go to Python, where a stack is kept.
    """
    rows = docs.select("doc_id", F.split("text", "\n").alias("l"))
    at = F.filter(F.sequence(F.lit(1), F.size("l")), lambda i: F.element_at("l", i).rlike(r"^#{1,6}[ \t]"))
    rows = rows.withColumn("h", at).withColumn("starts", F.when(F.get("h", F.lit(0)) == 1, F.col("h")).otherwise(F.concat(F.array(F.lit(1)), "h")))
    part = lambda s, i: F.slice("l", s, F.coalesce(F.get("starts", i + 1), F.size("l") + 1) - s)
    first = lambda s: F.element_at("l", s)
    named = lambda s: F.regexp_extract(first(s), r"^#{1,6}[ \t]+([^\n]*)", 1)
    rank = lambda s: F.length(F.regexp_extract(first(s), r"^(#{1,6})[ \t]", 1))
    sections = F.transform("starts", lambda s, i: F.struct(s.alias("s"), strip(F.array_join(part(s, i), "\n")).alias("text"), named(s).alias("header"), rank(s).alias("rank")))
    rows = rows.withColumn("x", sections)
    ship(docs.sparkSession)
    rows = rows.withColumn("paths", _paths(F.transform("x", lambda x: x["rank"]), F.transform("x", lambda x: x["header"])))
    named = F.zip_with("x", "paths", lambda x, p: F.struct(x["header"].alias("header"), p.alias("path"), x["text"].alias("text")))
    out = rows.select("doc_id", F.posexplode(F.filter(named, lambda x: x["text"] != "")).alias("section", "x"))
    return out.select("doc_id", "section", "x.header", "x.path", "x.text")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _paths(ranks: pd.Series, names: pd.Series) -> pd.Series:
    """The open headers at each section, from the sections' ranks (0: no header) and headers."""

    def walk(rank: Sequence[int], name: Sequence[str]) -> list[list[str]]:
        held: list[tuple[int, str]] = []
        out = []
        for r, n in zip(rank, name, strict=True):
            if r:
                while held and held[-1][0] >= r:
                    held.pop()
                held.append((r, n))
            out.append([x for _, x in held])
        return out

    return pd.Series([None if r is None else walk(r, n) for r, n in zip(ranks, names, strict=True)], dtype=object)


def threshold(d: Column, kind: str = "percentile", amount: float = 95.0) -> Column:
    """The distance from which a gap is a break; an unknown kind is a percentile."""
    if kind == "standard_deviation":
        return F.avg(d) + amount * F.stddev_pop(d)
    if kind == "absolute":
        return F.lit(float(amount))
    return F.percentile(d, amount / 100)


def semantic(sentences: DataFrame, kind: str = "percentile", amount: float = 95.0) -> DataFrame:
    """(doc_id, pos, distance, chunk): sentences (doc_id, pos, embedding) cut where neighbours are far apart."""
    by = Window.partitionBy("doc_id").orderBy("pos")
    gaps = sentences.withColumn("next", F.lead("embedding").over(by)).withColumn("distance", F.when(F.col("next").isNotNull(), F.round(V.cosine_distance("embedding", "next"), 6)))
    cut = gaps.groupBy("doc_id").agg(threshold(F.col("distance"), kind, amount).alias("cut"), F.count("*").alias("n"))
    marked = gaps.join(cut, "doc_id").withColumn("brk", ((F.col("distance") >= F.col("cut")) & (F.col("n") > 2)).cast("int"))
    before = F.sum(F.coalesce("brk", F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return marked.select("doc_id", "pos", "distance", F.coalesce(before, F.lit(0)).cast("long").alias("chunk"))
