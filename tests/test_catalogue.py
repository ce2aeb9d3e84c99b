"""Every query with SQL against DuckDB, and every other query for rows, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from repseq.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
        return str(x)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, small, duck, name):
    got = catalogue.queries()[name](spark, small)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows(spark, small, name):
    assert catalogue.queries()[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down(spark, small):
    """Scans read the columns that a query needs, and usage runs without Python workers."""
    plan = entry.queries()["count_genes_gene"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "Python" not in plan and "Arrow" not in plan


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).resolve().parents[1] / "repseq"
    for path in root.rglob("*.py"):
        assert path.parent.name == "llm" or "repseq.llm" not in path.read_text()
