"""Results to files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def testset(samples: DataFrame, path: str) -> None:
    """Files of JSON lines, a sample each, written by every task."""
    samples.write.mode("overwrite").json(path)


#: Samples that one file takes; larger sets are written by ``testset``.
MOST_SAMPLES = 100_000


def testset_file(samples: DataFrame, path: str, most: int = MOST_SAMPLES) -> None:
    """One JSON array in one file, made by one task. For test sets: their size is a parameter of the generation, and checked here."""
    if samples.limit(most + 1).count() > most:
        raise ValueError(f"over {most} samples; write them with testset()")
    row = F.to_json(F.struct(*samples.columns), {"ignoreNullFields": "false"})
    body = samples.agg(F.concat(F.lit("["), F.array_join(F.collect_list(row), ",\n"), F.lit("]")).alias("value"))
    body.coalesce(1).write.mode("overwrite").text(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def text_file(df_session, path: str, body: str) -> None:
    """A rendered report, through Spark's file systems."""
    df_session.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def json_rows(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def dumps(rows: list[dict]) -> str:
    return json.dumps(rows, ensure_ascii=False, indent=2, default=str)
