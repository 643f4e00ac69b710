"""Office documents as a data source of Spark's own reader.

    register(spark)
    spark.read.format("office").load("s3://bucket/folder")

Files are listed once and dealt into partitions of about PARTITION_BYTES; an executor opens its own files through Arrow's
file systems (local, S3, GCS, HDFS by the path's scheme). Columns are those of every loader; a file that can't be parsed is an
empty document with ``error``. Filters on source, file_name and file_type leave files out before they are opened
(``register`` turns ``spark.sql.python.filterPushdown.enabled`` on, which the session needs for that). ``loaders.docx`` and ``loaders.pptx`` read paths that only Spark can open.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from loomquery.plans.ship import ship
from loomquery.sources.loaders import DOCUMENT, parse_docx, parse_pptx

PARTITION_BYTES = 32 << 20
PARSERS = {"docx": parse_docx, "pptx": parse_pptx}


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _opened(source: str):
    """Arrow's file system and path of a source as Spark names it (local ones ``file:/...``)."""
    from pyarrow import fs

    local = source.removeprefix("file://").removeprefix("file:")
    return fs.FileSystem.from_uri(source) if "://" in local else (fs.LocalFileSystem(), local)


def _type(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


class OfficeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("office needs a path")
        self.path, self.recursive, self.filters = options["path"], options.get("recursive", "true").lower() == "true", []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what a path alone decides."""
        for f in filters:
            if isinstance(f, EqualTo | In | StringEndsWith | StringStartsWith) and f.attribute in (("source",), ("file_name",), ("file_type",)):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, source: str) -> bool:
        columns = {"source": source, "file_name": source.rsplit("/", 1)[-1], "file_type": _type(source)}
        tests = {EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, StringEndsWith: lambda v, x: v.endswith(x), StringStartsWith: lambda v, x: v.startswith(x)}
        return columns["file_type"] in PARSERS and all(tests[type(f)](columns[f.attribute[0]], f.value) for f in self.filters)

    def _listed(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        system, root = _opened(self.path)
        scheme = "file:" if isinstance(system, fs.LocalFileSystem) else self.path.split("://")[0] + "://"
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=self.recursive))
        return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and self._wanted(scheme + f.path))

    def partitions(self) -> list[InputPartition]:
        parts, held, size = [], [], 0
        for path, n in self._listed():
            if held and size + n > PARTITION_BYTES:
                parts.append(Files(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*parts, Files(held)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for source in partition.paths:
            try:
                system, path = _opened(source)
                with system.open_input_file(path) as f:
                    body, metadata = PARSERS[_type(source)](f.read())
            except Exception as e:  # noqa: BLE001  the row says what failed
                body, metadata = "", {"error": f"{type(e).__name__}: {e}"}
            yield source, source.rsplit("/", 1)[-1], _type(source), body, metadata


class Office(DataSource):
    @classmethod
    def name(cls) -> str:
        return "office"

    def schema(self) -> str:
        return DOCUMENT

    def reader(self, schema) -> DataSourceReader:
        return OfficeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format ``office`` known to this session."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Office)
