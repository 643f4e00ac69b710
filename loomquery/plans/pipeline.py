"""Load, clean and split as functions from DataFrame to DataFrame; ingestion with counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomquery.functions.text import clean_documents
from loomquery.operators import split
from loomquery.plans.llm import HttpEmbedder
from loomquery.plans.tables import save

Step = Callable[[DataFrame], DataFrame]


def build(splitter: str = "recursive", size: int = 500, overlap: int = 50, cjk: bool = True, custom: Step | None = None) -> Step:
    """clean, then split: ``recursive``, ``markdown`` or ``parent_child`` (parents three times the size)."""
    splits: dict[str, Step] = {
        "recursive": lambda df: split.recursive(df, size, overlap),
        "markdown": lambda df: split.markdown(df, size),
        "parent_child": lambda df: split.parent_child(df, (3 * size, 3 * overlap), (size, overlap)),
    }
    if splitter not in splits:
        raise ValueError(f"unknown splitter {splitter}; known: {sorted(splits)}")
    steps = [lambda df: clean_documents(df, cjk=cjk), *([custom] if custom else []), splits[splitter]]
    return lambda df: reduce(lambda d, f: f(d), steps, df)


def hashing_encoder(dim: int = 64):
    """The offline encoder: unit vectors of hashed word counts, a pandas UDF."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(s: pd.Series) -> pd.Series:
        from zlib import crc32

        def one(t):
            v = np.zeros(dim, dtype=np.float32)
            for w in (t or "").lower().split():
                h = crc32(w.encode())
                v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return s.map(one)

    return encode


def encoder(load: Callable[[], Callable[[list[str]], Sequence]], batch: int = 32, instruction: str = "", most: int | None = None):
    """A pandas UDF from texts to vectors by a model: ``load`` makes, once a Python worker, a function of texts to vectors.

    Texts go in batches, each after ``instruction`` (queries and passages may have different ones) and cut to
    ``most`` words.
    """
    made: list = []

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(s: pd.Series) -> pd.Series:
        if not made:
            made.append(load())
        texts = [instruction + (" ".join((t or "").split()[:most]) if most else t or "") for t in s]
        out: list = []
        for i in range(0, len(texts), batch):
            out += [[float(x) for x in v] for v in made[0](texts[i : i + batch])]
        return pd.Series(out, dtype=object)

    return encode


def remote_encoder(url: str, model: str, batch: int = 32, **options):
    """Vectors from an embeddings service."""
    return encoder(lambda: HttpEmbedder(url, model, batch=batch, **options).embed, batch)


def encode_groups(groups: DataFrame, embed, key: str, texts: str = "texts") -> DataFrame:
    """(key, embeddings): the vectors of each group's texts (an array column), in order. Texts of all groups share batches."""
    each = groups.select(key, F.posexplode_outer(texts).alias("_i", "_t")).withColumn("_v", F.when(F.col("_i").isNotNull(), embed(F.coalesce("_t", F.lit("")))))
    rows = F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", "_v"))))
    return each.groupBy(key).agg(F.transform(rows, lambda x: x["_v"]).alias("embeddings"))


#: Embedders by name: functions that make a pandas UDF.
EMBEDDERS: dict[str, Callable] = {"hashing": hashing_encoder, "model": encoder, "remote": remote_encoder}


def register_embedder(name: str, factory: Callable) -> None:
    EMBEDDERS[name] = factory


def counts(chunks: DataFrame) -> DataFrame:
    """One row: distinct sources (null is one) and chunks."""
    return chunks.agg(F.countDistinct(F.coalesce("source", F.lit("\u0000"))).alias("documents"), F.count("*").alias("chunks"))


def ingest(docs: DataFrame, step: Step, add: Callable[[DataFrame], int]) -> dict[str, int]:
    """Process and add; what was read, made and added."""
    made = save(step(docs), "chunks")
    r = counts(made).first()
    return {"documents": r["documents"], "chunks": r["chunks"], "added": add(made)}
