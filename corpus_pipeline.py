"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's result to the shared folder and reads it back for the next, which
then replaces it. Extra columns pass through all stages but the last, whatever their names (but for the prefix
``_lq_``); very long texts are taken whole; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomquery.llm import common, linededup, mixing, neardup, packing, quality
from loomquery.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: null, empty and blank texts (under 50 words) among them. Repeated rows are judged alike."""
    return quality.filter_quality(docs, common.table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; n_chars follows. Null texts stay null; documents that lose their last word go."""
    return linededup.apply_line_dedup(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest doc_id, null last. Equal rows count as one document."""
    return neardup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often (0 to 2 times) as its source's target takes it; a null source is one of its own."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. Null and empty texts give the end id alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: Shingle hashes and byte-pair ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), name, replaces=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
