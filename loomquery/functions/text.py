"""Text cleaning, hashing and parsing as Column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomquery.plans.ship import ship

#: Bytes of texts that are Python strings at a time (a longer text by itself).
PIECE = 1 << 20
#: Control, zero-width, line-separator and byte-order characters.
SPECIAL = "[\\x00-\\x1f\\x7f-\\x9f\\u200b-\\u200f\\u2028-\\u202f\\ufeff]"
#: CJK quotes and punctuation and what stands for them.
CJK_QUOTES = {"「": '"', "」": '"', "『": "'", "』": "'"}
CURLY_QUOTES = {"“": '"', "”": '"', "‘": "'", "’": "'"}
CJK_PUNCT = {"（": "(", "）": ")", "【": "[", "】": "]", "《": "<", "》": ">"}
CJK_PUNCT_LONG = {"——": "--", "…": "..."}
#: Labels of questions and answers in replies that aren't JSON.
QUESTION_LABELS = ("问题:", "Q:")
ANSWER_LABELS = ("答案:", "A:")
#: Fixed value: what follows a context that was cut.
TRUNCATED_CONTEXT = "\n\n[上下文已被截断...]"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.regexp_replace(_c(c), r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def _pieces(s: pa.Array) -> list[pa.Array]:
    """``s`` in slices of about PIECE bytes."""
    turn = np.cumsum(pc.fill_null(pc.binary_length(s), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // PIECE
    return [s.slice(a, b - a) for a, b in pairwise([0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(s)])]


@F.arrow_udf(T.StringType())
def _nfkc(s: pa.Array) -> pa.Array:
    normal = lambda t: None if t is None else unicodedata.normalize("NFKC", t)
    return pa.concat_arrays([pa.array([normal(t) for t in x.to_pylist()], pa.string()) for x in _pieces(s)])


def nfkc(c: str | Column) -> Column:
    """Unicode NFKC. ASCII texts don't reach Python: the function gets null for them.

    A worker holds an Arrow batch of bounded bytes and its result, and of it a PIECE at a time as strings.
    """
    ship(SparkSession.active())
    c = _c(c)
    return F.coalesce(_nfkc(F.when(c.rlike("[^\\x00-\\x7F]"), c)), c)


def strip_html(c: str | Column) -> Column:
    return F.regexp_replace(_c(c), "<[^>]+>", " ")


def special_chars(c: str | Column, pattern: str = SPECIAL) -> Column:
    return F.regexp_replace(_c(c), pattern, " ")


def whitespace(c: str | Column) -> Column:
    """Line ends unified, runs of blanks and of three or more line ends shortened, ends stripped."""
    c = F.regexp_replace(_c(c), "\r\n", "\n")
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n"))


def _translate(c: Column, table: dict[str, str]) -> Column:
    return F.translate(c, "".join(table), "".join(table.values()))


def cjk_quotes(c: str | Column, curly: bool = True) -> Column:
    return _translate(_c(c), CJK_QUOTES | (CURLY_QUOTES if curly else {}))


def half_width(c: str | Column) -> Column:
    """Full-width forms (U+FF01 to U+FF5E) and the ideographic space as their ASCII counterparts."""
    return _translate(_c(c), {chr(i): chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F)} | {"　": " "})


def cjk_punct(c: str | Column) -> Column:
    c = _translate(_c(c), CJK_PUNCT)
    for long, plain in CJK_PUNCT_LONG.items():
        c = F.replace(c, F.lit(long), F.lit(plain))
    return c


def clean(c: str | Column, *, normalize: bool = True, html: bool = True, special: bool = False, blanks: bool = True, lower: bool = False, custom: Iterable[Callable[[Column], Column]] = ()) -> Column:
    """The general cleaner; null becomes the empty string."""
    c = F.coalesce(_c(c), F.lit(""))
    for on, step in ((normalize, nfkc), (html, strip_html), (special, special_chars), (blanks, whitespace), (lower, F.lower)):
        c = step(c) if on else c
    for step in custom:
        c = step(c)
    return c


def clean_cjk(
    c: str | Column, *, normalize: bool = True, html: bool = True, special: bool = False, blanks: bool = True, lower: bool = False, custom: Iterable[Callable[[Column], Column]] = ()
) -> Column:
    """The cleaner for Chinese text: quotes, width and punctuation come after tags."""
    c = F.coalesce(_c(c), F.lit(""))
    steps = ((normalize, nfkc), (html, strip_html), (True, cjk_quotes), (True, half_width), (True, cjk_punct), (special, special_chars), (blanks, whitespace), (lower, F.lower))
    for on, step in steps:
        c = step(c) if on else c
    for step in custom:
        c = step(c)
    return c


def clean_documents(docs: DataFrame, text_col: str = "text", cjk: bool = False, **flags) -> DataFrame:
    return docs.withColumn(text_col, (clean_cjk if cjk else clean)(text_col, **flags))


def truncate(c: str | Column, most: int, suffix: str = "...") -> Column:
    c = _c(c)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, max(0, most - len(suffix))), F.lit(suffix))).otherwise(c)


def truncate_context(c: str | Column, most: int = 8000) -> Column:
    c = _c(c)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(TRUNCATED_CONTEXT))).otherwise(c)


def text_hash(c: str | Column, algorithm: str = "md5") -> Column:
    bits = {"sha256": 256, "sha512": 512}
    return F.md5(_c(c)) if algorithm == "md5" else F.sha2(_c(c), bits[algorithm])


def token_estimate(c: str | Column) -> Column:
    """1.5 for each CJK character, a quarter for each other, rounded down."""
    c = _c(c)
    other = F.length(F.regexp_replace(c, "[一-鿿]", ""))
    return F.floor(1.5 * (F.length(c) - other) + 0.25 * other).cast("int")


def token_estimate_plain(c: str | Column) -> Column:
    return F.floor(F.length(_c(c)) / 4).cast("int")


def human_size(n: str | Column) -> Column:
    n = _c(n).cast("double")
    shown = lambda i, unit: F.format_string("%.2f %s", F.bround(n / 1024.0**i, 2), F.lit(unit))
    out = shown(5, "PB")
    for i, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(n < 1024.0 ** (i + 1), shown(i, unit)).otherwise(out)
    return out


def extension(path: str | Column, dot: bool = True) -> Column:
    found = F.lower(F.regexp_extract(_c(path), r"\.[^./\\]+$", 0))
    return found if dot else F.substring(found, 2, 100)


def batch_number(order: Column, size: int) -> Column:
    """The batch of a row numbered from 1."""
    return F.floor((order - 1) / size)


def parse_lines(c: str | Column) -> Column:
    """The queries of a reply: one a line, numbering and bullets cut off, over two characters."""
    lines = F.transform(F.split(strip(c), "\n"), lambda x: strip(F.regexp_replace(strip(x), r"^[0-9.\-*、。,)）]+", "")))
    return F.filter(lines, lambda x: F.length(x) > 2)


def parse_answer(c: str | Column) -> Column:
    """Struct (question, answer) of a reply: JSON in or out of a code fence, else what stands before and after the first question mark, labels cut off."""
    c = strip(c)
    bare = strip(F.regexp_replace(c, r"^```[a-zA-Z]*\s*|\s*```$", ""))
    parsed = F.from_json(bare, "question string, answer string", {"mode": "PERMISSIVE"})
    valid = bare.startswith("{") & F.try_parse_json(bare).isNotNull()
    parts = F.split(bare, r"\?", -1)
    without = lambda x, labels: reduce(lambda s, w: F.replace(s, F.lit(w), F.lit("")), labels, x)
    question = F.concat(strip(without(F.get(parts, F.lit(0)), QUESTION_LABELS)), F.lit("?"))
    answer = strip(without(F.element_at(F.split(F.get(parts, F.lit(1)), ANSWER_LABELS[0], -1), -1), ANSWER_LABELS[1:]))
    cut = F.size(parts) > 1
    return F.struct(
        F.when(valid, F.coalesce(parsed["question"], F.lit(""))).when(cut, question).alias("question"),
        F.when(valid, F.coalesce(parsed["answer"], F.lit(""))).when(cut, answer).alias("answer"),
    )
