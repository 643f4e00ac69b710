"""Files to documents: (source, file_name, file_type, text, metadata map<string,string>).

Text formats are read by Spark's own readers. Office and PDF formats are read as binary files and parsed
in Arrow batches; PDF and image parsers are hooks, since they need libraries of their own.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import cache, reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomquery.plans.ship import ship
from loomquery.plans.tables import sized

#: Languages by suffix; other suffixes are text. The last is an addition.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".java": "java", ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp",
    ".cs": "csharp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".html": "html", ".css": "css",
    ".scss": "scss", ".json": "json", ".xml": "xml", ".yaml": "yaml", ".yml": "yaml", ".md": "markdown", ".sql": "sql", ".sh": "bash", ".bash": "bash", ".zsh": "bash",
    ".ps1": "powershell", ".bat": "batch", ".txt": "text",
    ".r": "r",
}
DOCUMENT = "source string, file_name string, file_type string, text string, metadata map<string,string>"


def _named(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumns({"source": F.col("_metadata.file_path"), "file_name": F.col("_metadata.file_name"), "file_type": F.lit(kind)})


def _whole(spark: SparkSession, path, kind: str, **options) -> DataFrame:
    return _named(spark.read.options(**options).text(path, wholetext=True), kind)


def _metadata(**values: Column) -> Column:
    pairs = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def _undecoded(text: str = "text") -> Column:
    """What is wrong with a text that was read: bytes that are no UTF-8, or what a reader puts for bytes that it can't decode."""
    return F.when(~F.is_valid_utf8(F.col(text)), F.lit("not valid UTF-8")).when(F.contains(F.col(text), F.lit("\ufffd")), F.lit("characters that its encoding lacks"))


def _done(df: DataFrame, **metadata: Column) -> DataFrame:
    """The columns of a document; a text that couldn't be decoded has ``error`` among its metadata, as files of other kinds do."""
    metadata.setdefault("error", _undecoded())
    return df.select("source", "file_name", "file_type", "text", _metadata(**metadata).alias("metadata"))


def markdown(spark: SparkSession, path, **options) -> DataFrame:
    """Front matter goes to the metadata; the title is its own, the first header or the file's stem."""
    df = _whole(spark, path, "markdown", **options).withColumnRenamed("value", "whole")
    front = F.regexp_extract("whole", r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    cut = lambda x: F.split(x, ":", 2)
    lines = F.transform(F.split(front, r"\r?\n"), lambda x: F.struct(F.trim(cut(x)[0]).alias("key"), F.trim(F.get(cut(x), F.lit(1))).alias("value")))
    pairs = F.filter(lines, lambda p: p["value"].isNotNull() & (p["key"] != "") & ~p["key"].startswith("#"))
    df = df.withColumns({"front": F.map_from_entries(pairs), "text": F.regexp_replace("whole", r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", "")})
    header = F.nullif(F.trim(F.regexp_extract("text", r"(?m)^#[ \t]+(.+)$", 1)), F.lit(""))
    title = F.coalesce(F.try_element_at("front", F.lit("title")), header, F.regexp_replace("file_name", r"\.[^.]*$", ""))
    own = _metadata(title=title)
    return df.select("source", "file_name", "file_type", "text", F.map_concat(F.map_filter("front", lambda k, _: k != "title"), own).alias("metadata"))


def code(spark: SparkSession, path, language: str | None = None, **options) -> DataFrame:
    df = _whole(spark, path, "code", **options).withColumnRenamed("value", "text")
    suffix = F.lower(F.regexp_extract("file_name", r"\.[^.]+$", 0))
    known = F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p])
    lang = F.lit(language) if language else F.coalesce(F.try_element_at(known, suffix), F.lit("text"))
    return _done(df, language=lang, line_count=F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)


def csv(
    spark: SparkSession, path, columns: list[str] | None = None, source_column: str | None = None, metadata_columns: list[str] | None = None,
    encoding: str | None = "utf-8", multiline: bool = True, **options,
) -> DataFrame:
    """A document for each row with some value: lines ``column: value``. ``row`` counts from 0 in each file.

    ``encoding`` None tries ENCODINGS on the files' bytes and takes the first that fits all. ``multiline``
    False lets a file of one row a line be split over tasks; rows are numbered by the totals of the parts
    before them, so no file is gathered in one task.
    """
    encoding = encoding or detect_encoding(spark, path, **options)
    if encoding.lower() not in SPARK_ENCODINGS:  # Spark's readers know Java's other charsets only by this setting
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    read = spark.read.options(header=True, multiLine=multiline, encoding=encoding, quote='"', escape='"', **options).csv(path)
    df = _numbered(_named(read, "csv"))
    cells = F.array(*[F.when(F.coalesce(F.col(f"`{c}`"), F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.col(f"`{c}`"))) for c in columns or read.columns])
    df = df.withColumn("text", F.array_join(F.array_compact(cells), "\n")).filter("text <> ''")
    if source_column:
        df = df.withColumn("source", F.coalesce(F.col(source_column), F.col("source")))
    return _done(df, row=F.col("row"), **{c: F.col(f"`{c}`") for c in metadata_columns or []})


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` (rows as read, with ``source``) with ``row``: the place in the file, from 0.

    A row's id holds its partition and its place there. The partitions' counts and first ids for each file,
    a table of a row for each part of a file, turn it into the place in the file.
    """
    df = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    parts = df.groupBy("source", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("source", "_part", (before - F.col("_first")).alias("_shift"))
    return df.join(sized(starts), ["source", "_part"]).withColumn("row", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


#: Encodings that Spark's readers take without a setting.
SPARK_ENCODINGS = ("iso-8859-1", "us-ascii", "utf-8", "utf-16", "utf-16be", "utf-16le", "utf-32")
#: Encodings that are tried in turn; UTF-16 counts only with its mark, and the last fits any bytes.
ENCODINGS = ("utf-8", "utf-16", "gb18030", "iso-8859-1")


@F.pandas_udf(T.IntegerType())
def _encoding(contents: pd.Series) -> pd.Series:
    """The place in ENCODINGS of the first that fits."""

    def first(content: bytes) -> int:
        for i, name in enumerate(ENCODINGS[:-1]):
            if name == "utf-16" and content[:2] not in (b"\xff\xfe", b"\xfe\xff"):
                continue
            try:
                content.decode(name)
                return i
            except UnicodeDecodeError:
                continue
        return len(ENCODINGS) - 1

    return contents.map(first)


def detect_encoding(spark: SparkSession, path, **options) -> str:
    """The first of ENCODINGS in which the files can be read; of several files the last in that order."""
    ship(spark)
    found = spark.read.format("binaryFile").options(**options).load(path).select(F.max(_encoding("content")).alias("i")).first()["i"]
    return ENCODINGS[found or 0]


def required_csv(spark: SparkSession, path, columns: list[str], **options) -> DataFrame:
    if not columns:
        raise ValueError("name the columns to read")
    return csv(spark, path, columns, **options)


def text(spark: SparkSession, path, **options) -> DataFrame:
    return _done(_whole(spark, path, "text", **options).withColumnRenamed("value", "text"))


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _plain(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if _tag(x) == "t").strip()


def _rows(table: ElementTree.Element) -> list[str]:
    out = []
    for row in (x for x in table if _tag(x) == "tr"):
        cells = [" ".join(filter(None, (_plain(p) for p in cell.iter() if _tag(p) == "p"))) for cell in row if _tag(cell) == "tc"]
        out.append(" | ".join(cells))
    return [r for r in out if r.strip(" |")]


def parse_docx(content: bytes) -> tuple[str, dict[str, str]]:
    """Paragraphs and tables in order of the body."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find("{*}body")
    blocks, counts = [], {"p": 0, "tbl": 0}
    for e in body if body is not None else ():
        if _tag(e) in counts:
            counts[_tag(e)] += 1
            blocks.append(_plain(e) if _tag(e) == "p" else "\n".join(_rows(e)))
    return "\n\n".join(b for b in blocks if b), {"paragraphs": str(counts["p"]), "tables": str(counts["tbl"])}


def parse_pptx(content: bytes) -> tuple[str, dict[str, str]]:
    """Slides in order; in each, shapes from top to bottom and left to right, groups opened."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))

    def shapes(e: ElementTree.Element) -> Iterator[tuple[int, int, str]]:
        for x in e:
            if _tag(x) == "grpSp":
                yield from shapes(x)
            elif _tag(x) in ("sp", "graphicFrame"):
                off = next((o for o in x.iter() if _tag(o) == "off"), None)
                at = (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else (0, 0)
                tables = [t for t in x.iter() if _tag(t) == "tbl"]
                body = "\n".join(r for t in tables for r in _rows(t)) if tables else "\n".join(filter(None, (_plain(p) for p in x.iter() if _tag(p) == "p")))
                yield *at, body

    slides = []
    for i, name in enumerate(names, 1):
        found = [s for tree in ElementTree.fromstring(z.read(name)).iter() if _tag(tree) == "spTree" for s in shapes(tree)]
        slides.append("\n".join([f"[Slide {i}]", *(t for _, _, t in sorted(found, key=lambda s: s[:2]) if t)]))
    return "\n\n".join(slides), {"total_slides": str(len(names))}


def pages_parser(pages: Callable[[bytes], list[str]]) -> Callable[[bytes], tuple[str, dict[str, str]]]:
    """A parser from a function of a file to its pages' texts, for PDF libraries."""

    def parse(content: bytes) -> tuple[str, dict[str, str]]:
        found = pages(content)
        return "\n\n".join(f"[Page {i}]\n{t}" for i, t in enumerate(found, 1)), {"total_pages": str(len(found))}

    return parse


def image_parser(lines: Callable[[bytes], list[str]]) -> Callable[[bytes], tuple[str, dict[str, str]]]:
    """A parser from a function that reads an image's lines."""

    def parse(content: bytes) -> tuple[str, dict[str, str]]:
        found = lines(content)
        return "\n".join(found), {"ocr_detected": str(bool(found)).lower(), "detected_lines": str(len(found))}

    return parse


def binary(spark: SparkSession, path, parse: Callable[[bytes], tuple[str, dict[str, str]]], kind: str, **options) -> DataFrame:
    """Whole files through ``parse``. A file that can't be parsed is an empty document with ``error``."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for source, content in zip(df["path"], df["content"], strict=True):
                try:
                    body, metadata = parse(bytes(content))
                except Exception as e:  # noqa: BLE001  the row says what failed
                    body, metadata = "", {"error": f"{type(e).__name__}: {e}"}
                rows.append((source, source.rsplit("/", 1)[-1], kind, body, metadata))
            yield pd.DataFrame(rows, columns=["source", "file_name", "file_type", "text", "metadata"])

    return spark.read.format("binaryFile").options(**options).load(path).select("path", "content").mapInPandas(run, DOCUMENT)


def docx(spark: SparkSession, path, **options) -> DataFrame:
    return binary(spark, path, parse_docx, "docx", **options)


def pptx(spark: SparkSession, path, **options) -> DataFrame:
    return binary(spark, path, parse_pptx, "pptx", **options)


def _pdf_pages(content: bytes) -> list[str]:
    from pypdf import PdfReader  # an optional library of the executors

    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]


@cache
def _ocr_engine():
    """One engine a Python worker, made when first needed."""
    from rapidocr_onnxruntime import RapidOCR  # an optional library of the executors

    return RapidOCR()


def _image_lines(content: bytes) -> list[str]:
    found, _ = _ocr_engine()(content)
    return [line[1] for line in found or []]


def pdf(spark: SparkSession, path, pages: Callable[[bytes], list[str]] = _pdf_pages, **options) -> DataFrame:
    """Pages by a function of the file; the default needs pypdf where executors run, else documents say what is missing."""
    return binary(spark, path, pages_parser(pages), "pdf", **options)


def image(spark: SparkSession, path, lines: Callable[[bytes], list[str]] = _image_lines, **options) -> DataFrame:
    """Lines of a picture; the default needs rapidocr_onnxruntime where executors run."""
    return binary(spark, path, image_parser(lines), "image", **options)


#: Reader by suffix; ``register`` adds to it.
READERS: dict[str, Callable[..., DataFrame]] = {
    **dict.fromkeys(LANGUAGES, code), ".md": markdown, ".markdown": markdown, ".csv": csv, ".docx": docx, ".pptx": pptx, ".txt": text,
    ".pdf": pdf, ".png": image, ".jpg": image, ".jpeg": image,
}


def register(suffix: str, reader: Callable[..., DataFrame]) -> None:
    READERS[suffix.lower()] = reader


def supported(path: str) -> bool:
    return _suffix(path) in READERS


def _suffix(path: str) -> str:
    found = re.search(r"\.[^./\\]+$", path)
    return found[0].lower() if found else ""


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    if not supported(path):
        raise ValueError(f"no reader for {path!r}; known: {sorted(READERS)}")
    return READERS[_suffix(path)](spark, path, **options)


def errors(docs: DataFrame) -> DataFrame:
    """(source, error): what went wrong, by file, once for each file and kind of trouble."""
    return docs.select("source", F.try_element_at("metadata", F.lit("error")).alias("error")).filter("error is not null").distinct()


def load_all(spark: SparkSession, paths: list[str], on_error: Callable[[str, Exception], None] | None = None) -> DataFrame:
    """Files of any kinds in one plan: a read for each suffix.

    A file that isn't there, or has no reader, raises; with ``on_error`` it is told of and left out.
    """
    by: dict[Callable[..., DataFrame], list[str]] = {}
    for p in paths:
        try:
            if not supported(p):
                raise ValueError(f"no reader for {p!r}; known: {sorted(READERS)}")
            if on_error and not _exists(spark, p):
                raise FileNotFoundError(p)
            by.setdefault(READERS[_suffix(p)], []).append(p)
        except (ValueError, FileNotFoundError) as e:
            if on_error is None:
                raise
            on_error(p, e)
    return reduce(DataFrame.unionByName, [f(spark, ps) for f, ps in by.items()]) if by else spark.createDataFrame([], DOCUMENT)


def files(spark: SparkSession, directory: str, suffixes: list[str] | None = None, recursive: bool = False) -> DataFrame:
    """(path, length, modified) of a directory's files; contents aren't read. A directory that isn't there has none."""
    if not _exists(spark, directory):
        return spark.createDataFrame([], "path string, length long, modified timestamp")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(directory).select("path", "length", F.col("modificationTime").alias("modified"))
    return df.filter(F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)).isin([s.lower() for s in suffixes])) if suffixes else df


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def directory(spark: SparkSession, path: str, suffixes: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """All supported files of a directory as documents: a filtered read for each kind of file, in any case of its suffix."""
    wanted = [s for s in (suffixes or list(READERS)) if s.lower() in READERS]
    present = [r["s"] for r in files(spark, path, wanted, recursive).select(F.regexp_extract("path", r"\.[^./]+$", 0).alias("s")).distinct().collect()]
    parts = [READERS[s.lower()](spark, path, recursiveFileLookup=recursive, pathGlobFilter=f"*{s}") for s in sorted(present)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], DOCUMENT)


def file_hash(spark: SparkSession, path: str, algorithm: str = "md5") -> DataFrame:
    digest = F.md5("content") if algorithm == "md5" else F.sha2("content", {"sha256": 256, "sha512": 512}[algorithm])
    return spark.read.format("binaryFile").load(path).select("path", digest.alias("hash"))


def testset(spark: SparkSession, path: str) -> DataFrame:
    """Samples from JSON, a sample a line or an array a file; missing keys get defaults.

    A file that starts with ``[`` is read whole, others by line.
    """
    sample = T.StructType([*[T.StructField(c, T.StringType()) for c in ("question", "answer", "ground_truth_context")], T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    arrays = {r["file"] for r in lines.filter(F.ltrim("value").startswith("[")).select("file").distinct().collect()}
    others = lines.filter(~F.col("file").isin(list(arrays))) if arrays else lines
    df = others.select(F.from_json("value", sample).alias("x")).filter("x is not null")
    if arrays:
        whole = spark.read.text(sorted(arrays), wholetext=True)
        df = df.unionByName(whole.select(F.explode(F.from_json("value", T.ArrayType(sample))).alias("x")))
    metadata = F.coalesce("x.metadata", F.create_map().cast("map<string,string>")).alias("metadata")
    return df.select(*[F.coalesce(f"x.{c}", F.lit("")).alias(c) for c in ("question", "answer", "ground_truth_context")], metadata)
