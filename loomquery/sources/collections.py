"""Collections: versioned Parquet tables of records (id, document, embedding, metadata) and a knowledge base on them."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.functions.vector import score
from loomquery.operators.ivf import VectorIndex
from loomquery.operators.knn import search
from loomquery.plans.tables import save, sized, top

RECORD = "id string, document string, embedding array<float>, metadata map<string,string>"
#: Metadata keys that are never stored.
NEVER_STORED = ("allowed_record_count", "total_record_count")


def record_id(source: Column, index: Column, text: Column) -> Column:
    """The same id for the same chunk, whenever and wherever it is added."""
    return F.sha2(F.concat_ws("\u0001", source, index.cast("string"), text), 256)


def _as_text(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def _equals(c: Column, v) -> Column:
    """Whether a metadata text is ``v``: by its text, or by its number. Never null where there is a text."""
    same = c == _as_text(v)
    if isinstance(v, int | float) and not isinstance(v, bool):
        same = same | F.coalesce(c.try_cast("double") == float(v), F.lit(False))
    return same


def _one_of(c: Column, values) -> Column:
    return reduce(lambda a, b: a | b, [_equals(c, v) for v in values], F.lit(False) & c.isNotNull())


def _compared(c: Column, v) -> Column:
    """The side of a metadata text that orders like ``v``; null if it is no number and ``v`` is one."""
    return c.try_cast("double") if isinstance(v, int | float) and not isinstance(v, bool) else c


_TEXT_OPS = {
    "$eq": _equals, "$ne": lambda c, v: ~_equals(c, v), "$in": _one_of, "$nin": lambda c, v: ~_one_of(c, v),
    "$gt": lambda c, v: _compared(c, v) > v, "$gte": lambda c, v: _compared(c, v) >= v, "$lt": lambda c, v: _compared(c, v) < v, "$lte": lambda c, v: _compared(c, v) <= v,
}
_OPS = {
    "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v)),
    "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
}


def _terms(v) -> list[tuple[str, object]]:
    """A key's filter as (operator, value) pairs."""
    return list(v.items()) if isinstance(v, dict) else [("$in", v)] if isinstance(v, list | tuple) else [("$eq", v)]


def where(filters: dict, column: Callable[[str], Column] | None = None) -> Column:
    """A predicate from a filter: scalars are equalities, lists memberships, dicts operators; $and and $or nest.

    Metadata are texts: a number equals the texts that read as it, a boolean ``true`` and ``false``; order compares numbers
    with texts that read as numbers only. A missing key fulfils nothing. With ``column`` the keys are columns with
    types of their own instead.
    """
    of, ops = (column, _OPS) if column else (lambda k: F.try_element_at(F.col("metadata"), F.lit(k)), _TEXT_OPS)
    parts = []
    for k, v in filters.items():
        if k in ("$and", "$or"):
            parts.append(reduce(lambda a, b: a & b if k == "$and" else a | b, [where(f, column) for f in v]))  # noqa: B023
        else:
            parts += [ops[op](of(k), x) for op, x in _terms(v)]
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


#: What a typed column can tell for certain, by its type: comparisons that hold for its value and for nothing else.
_SURE = {"double": (int, float), "string": (str,)}


def typed_where(filters: dict, columns: dict[str, str]) -> Column | None:
    """What typed columns (key to type, see ``Collection``) say of a filter: true wherever ``where`` is, and understood by a scan."""
    parts = []
    for k, v in filters.items():
        if k in ("$and", "$or"):
            inner = [typed_where(f, columns) for f in v]
            if k == "$and" and any(x is not None for x in inner):
                parts.append(reduce(lambda a, b: a & b, [x for x in inner if x is not None]))
            elif k == "$or" and inner and all(x is not None for x in inner):
                parts.append(reduce(lambda a, b: a | b, inner))
            continue
        for op, x in _terms(v) if k in columns else ():
            values = list(x) if op == "$in" else [x]
            if op in ("$ne", "$nin") or not values or not all(isinstance(y, _SURE[columns[k]]) and not isinstance(y, bool) for y in values):
                continue
            parts.append(_OPS[op](F.col(f"m_{k}"), values if op == "$in" else x))
    return reduce(lambda a, b: a & b, parts) if parts else None


def one_by_id(records: DataFrame) -> DataFrame:
    """One record of each id: the first by document, then by metadata and vector as JSON."""
    order = [F.col("document").asc_nulls_last(), F.to_json(F.struct(F.array_sort(F.map_entries("metadata")), "embedding"))]
    return top(records, 1, ["id"], *order, rank="_n").drop("_n")


def stored(records: DataFrame) -> DataFrame:
    return records.withColumn("metadata", F.map_filter("metadata", lambda k, v: v.isNotNull() & ~k.isin(*NEVER_STORED)))


class Collection:
    """A log of versions over appended Parquet folders.

    A change writes only what it changes: new records to a folder of ``data``, the ids that it takes away
    from earlier folders to one of ``gone``. Folders are named by version and a random part, so writers never
    share one. Then one small file in ``log`` names all folders of the version: readers never see half a
    write, and of two writers of one version the second fails. ``compact`` folds the folders into one.

    ``columns`` (key to ``double`` or ``string``) are metadata keys that new folders also hold as columns of that type,
    ``m_`` and the key, null where the text doesn't read as one. Files keep their statistics, and filters on these keys are
    pushed into the scan if all folders hold them; ``frequent_keys`` names candidates, and ``compact`` brings older
    folders up to it. The map keeps every key as text, so mixed values stay what they are.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, metric: str = "cosine", embed: Callable[[Column], Column] | None = None, columns: dict[str, str] | None = None):
        self.spark, self.root, self.name, self.metric, self.embed, self.columns = spark, root.rstrip("/"), name, metric, embed, columns or {}
        if unknown := set(self.columns.values()) - set(_SURE):
            raise ValueError(f"unknown column types {sorted(unknown)}")
        self.path = f"{self.root}/{name}"

    def _fs(self, path: str = ""):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path + path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._fs("/log")
        if not fs.exists(p):
            return []
        found = [re.fullmatch(r"(\d+)\.json", s.getPath().getName()) for s in fs.listStatus(p)]
        return sorted(int(m[1]) for m in found if m)

    def exists(self) -> bool:
        return bool(self.versions())

    def _folders(self, version: int | None = None) -> dict[str, list[str]]:
        have = self.versions()
        if not have:
            return {"data": [], "gone": []}
        p, fs = self._fs(f"/log/{have[-1] if version is None else version}.json")
        opened = fs.open(p)
        try:
            return json.loads(bytes(opened.readAllBytes()).decode())
        finally:
            opened.close()

    def typed(self, version: int | None = None) -> dict[str, str]:
        """The typed columns that all folders of a version hold."""
        folders = self._folders(version)
        held = [folders.get("typed", {}).get(n, {}) for n in folders["data"]]
        return {k: v for k, v in held[0].items() if all(h.get(k) == v for h in held)} if held else {}

    def read(self, version: int | None = None, filters: dict | None = None, since: int | None = None) -> DataFrame:
        """The records of a version that a filter lets through; of those, the ones that came after version ``since``."""
        folders, typed = self._folders(version), self.typed(version)
        if since is not None:
            folders["data"] = [n for n in folders["data"] if n not in self._folders(since)["data"]]
        if not folders["data"]:
            return self.spark.createDataFrame([], RECORD)

        def kind(name: str, schema: str) -> DataFrame:
            reader = self.spark.read.option("basePath", f"{self.path}/{name}").schema(f"{schema}, seq string")
            return reader.parquet(*[f"{self.path}/{name}/seq={n}" for n in folders[name]])

        rows = kind("data", ", ".join([RECORD, *[f"`m_{k}` {v}" for k, v in typed.items()]]))
        if filters:
            sure = typed_where(filters, typed)
            rows = (rows if sure is None else rows.filter(sure)).filter(where(filters))
        if folders["gone"]:
            last = kind("gone", "id string").groupBy("id").agg(F.max("seq").alias("until")).withColumnRenamed("id", "gone_id")
            rows = rows.join(last, (F.col("id") == F.col("gone_id")) & (F.col("seq") < F.col("until")), "left_anti")
        return rows.select("id", "document", "embedding", "metadata")

    def frequent_keys(self, share: float = 0.5) -> dict[str, str]:
        """Metadata keys that at least ``share`` of the records have, with the type that all their texts read as."""
        pairs = self.read().select(F.explode("metadata").alias("k", "v")).groupBy("k")
        number = F.min(F.col("v").try_cast("double").isNotNull().cast("int")).alias("number")
        least = share * self.count()
        found = pairs.agg(F.count("*").alias("n"), number).filter(F.col("n") >= least).collect()
        return {r["k"]: "double" if r["number"] else "string" for r in sorted(found, key=lambda r: r["k"])}

    def _commit(self, data: DataFrame | None = None, gone: DataFrame | None = None, alone: bool = False, once: tuple[str, int] | None = None) -> DataFrame | None:
        """Write a version; what was added, read back."""
        have, folders = self.versions(), self._folders()
        n = have[-1] + 1 if have else 0
        folder = f"{n:010d}-{uuid.uuid4().hex}"
        if alone:
            folders = {**folders, "data": [], "gone": [], "typed": {}}
        if once:
            folders["streams"] = {**folders.get("streams", {}), once[0]: once[1]}
        typed = [F.try_element_at(F.col("metadata"), F.lit(k)).try_cast(v).alias(f"m_{k}") for k, v in self.columns.items()]
        if data is not None:
            folders["typed"] = {**folders.get("typed", {}), folder: self.columns}
        for name, df, columns in (("data", data, ["id", "document", "embedding", "metadata", *typed]), ("gone", gone, ["id"])):
            if df is not None:
                df.select(*columns).write.parquet(f"{self.path}/{name}/seq={folder}")
                folders[name] = [*folders[name], folder]
        p, fs = self._fs(f"/log/{n}.json")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        return self.spark.read.schema(RECORD).parquet(f"{self.path}/data/seq={folder}") if data is not None else None

    def add(self, records: DataFrame) -> int:
        """Append records whose ids are new; the number added. A missing id is drawn, a missing embedding computed."""
        new = one_by_id(self._complete(records)).join(self.read().select("id"), "id", "left_anti")
        return self._commit(new).count()

    def _complete(self, records: DataFrame) -> DataFrame:
        have = set(records.columns)
        drawn = F.expr("uuid()")
        out = records.withColumn("id", F.coalesce(F.col("id").cast("string"), drawn) if "id" in have else drawn)
        if self.embed:
            made = self.embed(F.col("document"))
            out = out.withColumn("embedding", F.coalesce("embedding", made) if "embedding" in have else made)
        elif "embedding" not in have:
            out = out.withColumn("embedding", F.lit(None).cast("array<float>"))
        out = out if "metadata" in have else out.withColumn("metadata", F.create_map().cast("map<string,string>"))
        return stored(out.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))).select("id", "document", "embedding", "metadata")

    def upsert(self, records: DataFrame, once: tuple[str, int] | None = None) -> bool:
        """Add records, each in place of the one that has its id, if any; of several with one id the first (``one_by_id``) stays.

        ``once`` names a stream and the number of its batch: a batch that a version has already, or a later one, changes nothing (False).
        """
        if once and self._folders().get("streams", {}).get(once[0], -1) >= once[1]:
            return False
        new = save(one_by_id(self._complete(records)), "upsert")
        self._commit(new, new.select("id"), once=once)
        return True

    def update(self, records: DataFrame) -> None:
        """Replace records that exist; others are ignored."""
        there = save(one_by_id(self._complete(records)).join(self.read().select("id"), "id", "left_semi"), "update")
        self._commit(there, there.select("id"))

    def delete(self, ids: list[str] | None = None, filters: dict | None = None) -> bool:
        if not ids and not filters:
            return False
        chosen = self.read().filter(F.col("id").isin(ids)) if ids else self.read(filters=filters)
        self._commit(gone=chosen.select("id"))
        return True

    def remove(self, ids: DataFrame) -> None:
        """Take the records with these ids (id) away, however many."""
        self._commit(gone=self.read().join(sized(ids.select("id").distinct()), "id", "left_semi").select("id"))

    def compact(self, columns: dict[str, str] | None = None) -> None:
        """All records in one folder, as a new version, with the typed ``columns`` if given; older versions stay readable."""
        self.columns = self.columns if columns is None else columns
        self._commit(self.read(), alone=True)

    def scan(self, limit: int | None = 1000, filters: dict | None = None) -> DataFrame:
        df = self.read(filters=filters).withColumn("score", F.lit(1.0))
        return df.orderBy("id").limit(limit) if limit else df

    def count(self) -> int:
        return self.read().count()

    def build_index(self, **options) -> VectorIndex:
        """Store a vector index of the latest version (``operators.ivf``) for approximate searches of it and later ones."""
        return VectorIndex.build(self.read(), f"{self.path}/index/{self.versions()[-1]}", "id", "embedding", self.metric, **options)

    def _indexed(self) -> int | None:
        """The latest version with an index whose folders are all part of the collection yet."""
        p, fs = self._fs("/index")
        have = sorted((int(s.getPath().getName()) for s in fs.listStatus(p)), reverse=True) if fs.exists(p) else []
        now = set(self._folders()["data"])
        return next((v for v in have if set(self._folders(v)["data"]) <= now), None)

    def _approximate(self, queries: DataFrame, k: int, probes: int | None) -> DataFrame | None:
        """The nearest by the index, without what was taken away since, and exactly of what came since; None without an index."""
        version = self._indexed()
        if version is None:
            return None
        later = [n for n in self._folders()["gone"] if n not in self._folders(version)["gone"]]
        gone = self.spark.read.schema("id string").parquet(*[f"{self.path}/gone/seq={n}" for n in later]).distinct() if later else None
        old = VectorIndex(self.spark, f"{self.path}/index/{version}").search(queries, k, probes, gone)
        new = search(self.read(since=version), queries, k, self.metric, None, "id")
        return top(old.unionByName(new).drop("rank"), k, ["query_id"], F.col("distance"), F.col("id"))

    def search(self, queries: DataFrame, k: int = 5, filters: dict | None = None, threshold: float | None = None, approximate: bool = False, probes: int | None = None) -> DataFrame:
        """(query_id, id, distance, score, rank) for queries with a vector (``query``) or, if the collection embeds, a text (``text``).

        Results under ``threshold`` go: scores are similarities, so higher is nearer for every metric. ``approximate`` reads
        the lists that the queries probe of the index of ``build_index``; with ``filters``, or without an index, the search is exact.
        """
        if "query" not in queries.columns:
            if not self.embed:
                raise ValueError("a collection without an embedder needs query vectors")
            queries = save(queries.select("query_id", self.embed(F.col("text")).alias("query")), "queries")
        queries = queries.select("query_id", "query")
        found = self._approximate(queries, k, probes) if approximate and not filters else None
        if found is None:
            found = search(self.read(filters=filters), queries, k, self.metric, None, "id")
        scored = found.withColumn("score", F.round(score(F.col("distance"), self.metric), 6))
        return scored if threshold is None else scored.filter(F.col("score") >= threshold)

    def reset(self, confirm: bool = False) -> bool:
        if not confirm:
            return False
        p, fs = self._fs()
        return fs.delete(p, True)

    @staticmethod
    def names(spark: SparkSession, root: str) -> list[str]:
        """The collections under a folder."""
        base = Collection(spark, root, "")
        p, fs = base._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if Collection(spark, root, s.getPath().getName()).exists()) if fs.exists(p) else []


class KnowledgeBase:
    """Documents with source, added_at and doc_id on a collection."""

    def __init__(self, collection: Collection, embed: Callable[[Column], Column] | None = None):
        self.collection, self.embed = collection, embed or collection.embed
        collection.embed = collection.embed or self.embed

    @classmethod
    def open(cls, spark: SparkSession, root: str, name: str = "documents", embed: Callable[[Column], Column] | None = None, metric: str = "cosine") -> KnowledgeBase:
        """The knowledge base of that name, with the offline encoder if no other is given."""
        if embed is None:
            from loomquery.plans.pipeline import EMBEDDERS

            embed = EMBEDDERS["hashing"]()
        return cls(Collection(spark, root, name, metric, embed))

    def _stamped(self, docs: DataFrame, stamp: str) -> DataFrame:
        index = F.col("chunk_index") if "chunk_index" in docs.columns else F.lit(0)
        rows = docs if "id" in docs.columns else docs.withColumn("id", record_id(F.col("source"), index, F.col("text")))
        meta = F.create_map(F.lit("source"), F.col("source"), F.lit("doc_id"), F.col("id"), F.lit(stamp), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
        return rows.select("id", F.col("text").alias("document"), self.embed(F.col("text")).alias("embedding"), meta.alias("metadata"))

    def add_documents(self, docs: DataFrame) -> int:
        """Chunks (source, text[, chunk_index]) embedded and added."""
        return self.collection.add(self._stamped(docs, "added_at"))

    def add_files(self, paths: list[str], step: Callable[[DataFrame], DataFrame]) -> int:
        """Files loaded, processed (cleaned and split) and added; a file that can't be read is left out."""
        from loomquery.sources.loaders import load_all

        return self.add_documents(step(load_all(self.collection.spark, paths, lambda path, error: None)))

    def update_document(self, docs: DataFrame) -> None:
        """Records (id, source, text) that exist get new text, vector and metadata, with ``updated_at``."""
        self.collection.update(self._stamped(docs, "updated_at"))

    def search(self, queries: DataFrame, k: int = 5, filters: dict | None = None, threshold: float | None = None) -> DataFrame:
        """(query_id, id, content, source, distance, score, rank) for queries (query_id, text)."""
        found = self.collection.search(queries, k, filters, threshold)
        texts = self.collection.read().select("id", F.col("document").alias("content"), F.try_element_at("metadata", F.lit("source")).alias("source"))
        return texts.join(sized(found), "id").select("query_id", "id", "content", "source", "distance", "score", "rank")

    def delete(self, ids: list[str]) -> bool:
        return self.collection.delete(ids)

    def delete_by_source(self, source: str) -> bool:
        return self.collection.delete(filters={"source": source})

    def exists(self) -> bool:
        return self.collection.exists()

    def reset(self, confirm: bool = False) -> bool:
        return self.collection.reset(confirm)

    def stats(self) -> DataFrame:
        return stats(self.collection.read().select(F.try_element_at("metadata", F.lit("doc_id")).alias("doc_id"), F.try_element_at("metadata", F.lit("source")).alias("source")))


def stats(records: DataFrame) -> DataFrame:
    """One row: documents, chunks, distinct sources and their sorted names."""
    named = F.array_sort(F.collect_set("source"))
    names, count = F.array_join(named, ",").alias("sources"), F.size(named).cast("long").alias("source_count")
    return records.agg(names, F.count("*").alias("total_chunks"), count, F.countDistinct("doc_id").alias("document_count"))
