"""Every catalogue query that has SQL equals DuckDB; the others are tested beside."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from loomquery.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def _rows(columns, table):
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(flat, r)) for r in zip(*[table[c].to_pylist() for c in columns], strict=True)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, duck, sf, name):
    got = QUERIES[name](spark, sf).toArrow()
    want = duck.execute(ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert _rows(sorted(got.column_names), got) == _rows(sorted(got.column_names), want)


def test_single_leg_of_scores_that_round_to_the_same(spark, tmp_path):
    """Document 1 is a word longer than document 2: its raw score is lower, its score of six digits is the same."""
    c = duckdb.connect()
    text = "case doc_id when 1 then repeat('rare ', 20000) || 'more' when 2 then repeat('rare ', 20000) else 'common' end"
    c.execute(f"create table documents as select range doc_id, {text} as text from range(1, 63)")
    c.execute("create table benchmark as select 0::bigint item_id, 'rare' as text")
    for t in ("documents", "benchmark"):
        c.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    got = QUERIES["hybrid_single_leg"](spark, str(tmp_path)).select("query_id", "doc_id", "score", "rank").orderBy("rank").collect()
    want = c.execute(f"select query_id, doc_id, score, rank from ({ORACLES['hybrid_single_leg']}) order by rank").fetchall()
    assert [tuple(r) for r in got] == want == [(0, 2, 1.0, 1), (0, 1, 1.0, 2)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_plans(spark, sf):
    """Group limits run before the shuffle, filters reach the scan and only needed columns are read."""

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "WindowGroupLimit" in plan(QUERIES["knn_batch"](spark, sf))
    kept = plan(QUERIES["kb_filter"](spark, sf))
    assert "In(m_lang, [de,fr])" in kept and "GreaterThanOrEqual(m_n_chars,500.0)" in kept and "EqualTo(m_source,src1)" in kept
    assert "LessThan(m_size,2000.0)" in plan(QUERIES["kb_filter_mixed"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan(QUERIES["kb_stats"](spark, sf))
    assert "text:" not in plan(QUERIES["top_by_source"](spark, sf)).split("ReadSchema")[1]
    search = plan(QUERIES["hybrid_search"](spark, sf))
    assert search.count("Scan parquet") <= 8 and search.count("documents.parquet") == 0


def test_stands_without_the_training_data_operators(tmp_path):
    """A copy without llm, its tests and the pipeline, and one that still has corpus_pipeline.py."""
    root = Path(__file__).resolve().parents[1]
    for keep in (False, True):
        to = tmp_path / str(keep)
        shutil.copytree(root, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
        shutil.rmtree(to / "loomquery" / "llm", ignore_errors=True)
        shutil.rmtree(to / "tests" / "llm", ignore_errors=True)
        if not keep:
            (to / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e; q = e.queries(); assert not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q); print(len(q))"
        said = subprocess.run([sys.executable, "-c", code], cwd=to, capture_output=True, text=True, check=False)
        assert said.returncode == 0 and int(said.stdout) == len(QUERIES), said.stderr
        names = subprocess.run(["grep", "-rlE", "loomquery.llm|from loomquery import llm", "--include=*.py", "loomquery", "tests"], cwd=to, capture_output=True, text=True, check=False).stdout.split()
        assert names in ([], ["tests/test_queries.py"])
