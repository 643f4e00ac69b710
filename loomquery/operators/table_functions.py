"""Splitters as table functions, for SQL and lateral joins.

    register(spark)
    spark.sql("select d.doc_id, c.* from documents d, lateral split_text(d.text, 'recursive', 500, 50) c")

``split_text`` gives (chunk_index, total_chunks, text); with ``parent_child`` also parent_index and parent_content. Its
columns follow from the arguments when the query is analysed, so kind and sizes are constants. Null and blank texts have no chunks.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from loomquery.operators import split
from loomquery.plans.ship import ship

KINDS = ("recursive", "markdown", "parent_child")
_CHUNK = [T.StructField("chunk_index", T.IntegerType()), T.StructField("total_chunks", T.IntegerType()), T.StructField("text", T.StringType())]
_PARENT = [T.StructField("parent_index", T.IntegerType()), T.StructField("parent_content", T.StringType())]


def _options(kind: str | None, size: int | None, overlap: int | None) -> tuple[str, int, int]:
    kind = kind or KINDS[0]
    if kind not in KINDS:
        raise ValueError(f"unknown splitter {kind!r}; known: {KINDS}")
    size = split.SIZE if size is None else size
    overlap = (split.OVERLAP if overlap is None else overlap) if kind != "markdown" else 0
    if size < 1 or overlap < 0:
        raise ValueError("a size is positive, an overlap not negative")
    return kind, size, overlap


class SplitText:
    """The chunks of a text, in order."""

    @staticmethod
    def analyze(text: AnalyzeArgument, kind: AnalyzeArgument = None, size: AnalyzeArgument = None, overlap: AnalyzeArgument = None) -> AnalyzeResult:
        if not isinstance(text.dataType, T.StringType | T.NullType):
            raise ValueError(f"a text is a string, not {text.dataType.simpleString()}")
        if any(x is not None and not x.isConstantExpression for x in (kind, size, overlap)):
            raise ValueError("kind, size and overlap are constants")
        chosen, _, _ = _options(*(None if x is None else x.value for x in (kind, size, overlap)))
        return AnalyzeResult(T.StructType([*(_PARENT if chosen == "parent_child" else []), *_CHUNK]))

    def eval(self, text, kind=None, size=None, overlap=None):
        kind, size, overlap = _options(kind, size, overlap)
        if kind == "markdown":
            chunks = split.split_markdown_by_size(text, size) if text else []
        else:
            chunks = split.split_recursively(text, size, overlap) if text else []
        if kind != "parent_child":
            for i, c in enumerate(chunks):
                yield i, len(chunks), c
            return
        # a parent's children are a fifth of its size, as in the splitter's own defaults
        for p, parent in enumerate(chunks):
            own = split.split_recursively(parent, max(1, size // 5), overlap // 5)
            for i, c in enumerate(own):
                yield p, parent, i, len(own), c


def register(spark: SparkSession) -> None:
    """Make ``split_text`` known to this session's SQL."""
    ship(spark)
    spark.udtf.register("split_text", udtf(SplitText))
