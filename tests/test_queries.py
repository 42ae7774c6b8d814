import ast
from pathlib import Path

import duckdb
import pytest

from quadrille.plans import catalogue

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parents[1]


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, oracle, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(oracle.sql(catalogue.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_nothing_but_the_entry_module_knows_the_text_operators():
    for p in ROOT.rglob("*.py"):
        parts = p.relative_to(ROOT).parts
        if "llm" in parts or parts[0] in ("__spark_entry__.py", "corpus_pipeline.py", "tests"):
            continue
        names = [n for x in ast.walk(ast.parse(p.read_text())) for n in ([a.name for a in x.names] if isinstance(x, ast.Import) else [x.module or ""] if isinstance(x, ast.ImportFrom) else [])]
        assert not any("llm" in n or n == "corpus_pipeline" for n in names), p


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
