"""9. Line dedup by content-defined chunks of lines.

Lines that hold a word are hashed, and a rolling hash covers each two of them in a row. Its bits choose the boundaries, at
SCALES scales: at scale k a line opens a chunk if bit k of the rolling hash of it and the next one is set, and a line closes
one if bit 32 + k of the rolling hash of it and the one before is set. A chunk runs from an opening line to the
next closing one (and from the last opening line before it), blank lines between included, so each has two worded
lines or more. Boundaries depend on no line outside the chunk: wherever a passage stands, the same chunks are cut
from it. Chunks of one scale don't cover a passage to its edges; those of all scales overlap and do (shares by
length in the README). A chunk that smaller ones cover line by line is left out, as it could remove nothing more.

A chunk is removed wherever its text was already seen: the first occurrence by (doc_id with nulls last, text hash,
line) stays. A repeat that overlaps its own first occurrence stays. The first place of each line is never removed.

Chunks are matched by a pair of 64-bit hashes, one over line hashes and one over bytes; then the texts of
all chunks that share a pair are compared by their bytes, and a pair that stands for two texts is left
alone. Hashes are counted with map-side sums, so a chunk that a third of all documents hold moves once per
task; where its places meet what is known of it, such a hot chunk's rows are salted. Texts are dealt by
document, never by chunk, before the comparison.

Defined results: null text stays null, empty text stays empty, neither has chunks to remove. Rows with the
same doc_id and text are treated alike: their chunks count as one occurrence. Repeats within a text go
too. Lines that stay keep their order. Very long texts are taken whole. Other columns pass through, whatever
their names (but for the prefix ``_lq_``). Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm import common as C

#: Scales of boundaries: a passage of two lines is cut out whole with a chance of 1 - 0.75 ** SCALES.
SCALES = 16
#: Numbers (from 1) of the lines that hold a word, ``_lq_w``; the rolling hash of each two of them, ``_lq_r``.
_WORDED = r"filter(sequence(1, size(_lq_l)), i -> _lq_l[i - 1] rlike '[^ \t\n\x0B\f\r]')"
_ROLLING = "case when size(_lq_w) < 2 then cast(array() as array<long>) else transform(sequence(1, size(_lq_w) - 1), k -> xxhash64(_lq_h[_lq_w[k - 1] - 1], _lq_h[_lq_w[k] - 1])) end"
#: By scale, the places of rolling hashes that open or close; of these, (first, last) of each chunk.
_MARKS = "transform(sequence(0, {scales} - 1), f -> filter(transform(_lq_r, (r, k) -> struct(k, shiftrightunsigned(r, f) & 1 as o, shiftrightunsigned(r, 32 + f) & 1 as c)), x -> x.o + x.c > 0))"
_CUTS = """
array_distinct(flatten(transform(_lq_m, m -> filter(transform(m, (x, i) -> struct(x.k as a, case when x.o = 1 and x.c = 1 then x.k
  when x.o = 1 and get(m, i + 1).o = 0 then get(m, i + 1).k end as b)), x -> x.b is not null))))
"""
#: Chunks by line range, without those that chunks of two lines cover.
_CHUNKS = """
transform(filter(_lq_c, c -> c.a = c.b or exists(slice(_lq_r, c.a + 1, c.b - c.a + 1), r -> (r & shiftrightunsigned(r, 32) & {mask}L) = 0)),
  c -> named_struct('s', _lq_w[c.a], 'e', _lq_w[c.b + 1]))
"""
#: Of a chunk c: its hash over line hashes, its hash over bytes.
_CLASSES = r"""
transform(_lq_c, c -> named_struct('s', c.s, 'e', c.e, 'h1', xxhash64(slice(_lq_h, c.s, c.e - c.s + 1)), 'h2', xxhash64(array_join(slice(_lq_l, c.s, c.e - c.s + 1), '\n'))))
"""
#: The line numbers in the ranges ``_lq_x``, which may overlap; the lines outside them.
_GONE = "array_distinct(flatten(transform(_lq_x, x -> sequence(x.s, x.e))))"
_REST = "transform(array_except(sequence(1, size(_lq_l)), _lq_g), i -> _lq_l[i - 1])"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumn("_lq_id", C.key_of(F.col(id_col))).withColumn("_lq_t", F.xxhash64(C.text_of(text_col)))


def _lines(text_col: str):
    return F.split(C.text_of(text_col), "\n", -1)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scales: int = SCALES) -> DataFrame:
    """(_lq_id, _lq_t, at, s, e, h1, h2): chunks by line range, with their hashes and place ``at``."""
    df = _keyed(docs.select(id_col, text_col), id_col, text_col).withColumn("_lq_l", _lines(text_col)).withColumn("_lq_h", F.expr("transform(_lq_l, x -> xxhash64(x))"))
    df = df.withColumn("_lq_w", F.expr(_WORDED)).withColumn("_lq_r", F.expr(_ROLLING)).withColumn("_lq_m", F.expr(_MARKS.format(scales=scales)))
    df = df.withColumn("_lq_c", F.expr(_CUTS)).withColumn("_lq_c", F.expr(_CHUNKS.format(mask=(1 << scales) - 1)))
    df = df.select(id_col, "_lq_id", "_lq_t", F.explode(F.expr(_CLASSES)).alias("c"))
    doc = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_lq_t").alias("t"))
    place = F.struct(doc.alias("doc"), F.col("c.s").alias("s"), F.col("c.e").alias("e"))
    return df.select("_lq_id", "_lq_t", place.alias("at"), "c.*")


def _removals(docs: DataFrame, keyed: DataFrame, id_col: str, text_col: str, scales: int) -> DataFrame:
    """(_lq_id, _lq_t, _lq_x): for each document with some, its ranges of lines to remove.

    ``keyed`` is joined with all its columns, and the result isn't written, so that the rebuild uses the
    same exchange of texts again.
    """
    all_chunks = C.save(chunks(docs, id_col, text_col, scales), "chunks")
    again = C.save(all_chunks.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("at").alias("first")).filter("n > 1"), "again")
    later = (F.col("at.doc") != F.col("first.doc")) | (F.col("at.s") > F.col("first.e"))
    place, counts = F.struct("_lq_id", "_lq_t", "s"), again.select("h1", "h2", "n")
    seen = C.save(C.spread_join(all_chunks, again.drop("n"), ["h1", "h2"], place, counts=counts).withColumn("later", later).drop("at", "first"), "repeats")
    wanted = seen.groupBy("_lq_id", "_lq_t").agg(F.collect_set(F.struct("s", "e", "h1", "h2")).alias("w"))
    texts = keyed.join(wanted, ["_lq_id", "_lq_t"]).select("w", F.xxhash64(*docs.columns).alias("row"), _lines(text_col).alias("l"))
    texts = texts.select("row", F.explode(F.expr(r"transform(w, c -> named_struct('h1', c.h1, 'h2', c.h2, 'x', array_join(slice(l, c.s, c.e - c.s + 1), '\n')))")).alias("c"))
    same = texts.groupBy("c.h1", "c.h2").agg((F.min("c.x") == F.max("c.x")).alias("same"), F.max("row").alias("row")).filter("same and row is not null").select("h1", "h2")
    gone = C.spread_join(seen.filter("later"), same, ["h1", "h2"], place, "left_semi", counts)
    return gone.groupBy("_lq_id", "_lq_t").agg(F.collect_set(F.struct("s", "e")).alias("_lq_x"))


def _deduped(docs: DataFrame, id_col: str, text_col: str, scales: int) -> DataFrame:
    """``docs`` with text_col rewritten and _lq_lines, _lq_gone (lines before, lines removed)."""
    keyed = _keyed(docs, id_col, text_col)
    found = keyed.join(_removals(docs, keyed, id_col, text_col, scales), ["_lq_id", "_lq_t"], "left").withColumn("_lq_l", _lines(text_col)).withColumn("_lq_g", F.expr(_GONE))
    rest = F.when(F.col("_lq_x").isNull(), F.col(text_col)).otherwise(F.array_join(F.expr(_REST), "\n"))
    gone = F.when(F.col("_lq_x").isNull(), 0).otherwise(F.size("_lq_g"))
    done = found.withColumn("_lq_lines", F.size("_lq_l")).withColumn("_lq_gone", gone).withColumn(text_col, rest)
    return C.fence(done.drop("_lq_l", "_lq_x", "_lq_g"), text_col, "_lq_lines", "_lq_gone")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scales: int = SCALES) -> DataFrame:
    """One row per input row: id, n_lines, n_removed (lines), text (what stays)."""
    out = _deduped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", scales)
    return out.select(F.col("doc_id").alias(id_col), F.col("_lq_lines").cast("long").alias("n_lines"), F.col("_lq_gone").cast("long").alias("n_removed"), F.col("text").alias(text_col))


def apply_line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, scales: int = SCALES) -> DataFrame:
    """``docs`` with repeated chunks removed. Documents that lose their last word by that go; ``length_col`` follows the text."""
    out = _deduped(docs, id_col, text_col, scales).filter((F.col("_lq_gone") == 0) | F.col(text_col).rlike(r"[^ \t\n\x0B\f\r]"))
    if length_col:
        out = out.withColumn(length_col, F.when(F.col("_lq_gone") > 0, F.length(text_col).cast("long")).otherwise(F.col(length_col)))
    return out.select(*docs.columns)
