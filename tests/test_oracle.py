"""Every registered query against its DuckDB twin (sf0.001): same columns,
same row count, same values (exact, after sorting)."""

import pytest

from compare import compare, duck
from conftest import SF001

import __spark_entry__ as E
from quilt.plans import catalog

QUERIES = catalog.SPARK
SQL = catalog.SQL


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    res = compare(spark, con, name, QUERIES[name], SQL.get(name), SF001)
    assert res[1] in ("ok", "rows-only"), res


def test_every_key_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


def test_appended_rows_are_seen(spark, tmp_path):
    from quilt.plans.ensembles import Config, workbench

    rows = spark.read.parquet(f"{SF001}/lineitem.parquet")
    rows.limit(1000).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = workbench(spark, str(tmp_path), Config()).counts().agg({"n": "sum"}).first()[0]
    rows.limit(500).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    w = workbench(spark, str(tmp_path), Config())
    assert before == 1000 and w.counts().agg({"n": "sum"}).first()[0] == 1500 == w.points().count()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"group_id", "n", "correct", "accuracy_pct"}


def test_queries_read_whole_tables():
    import re

    for name, sql in SQL.items():
        upper = sql.upper()
        assert not re.search(r"\bLIMIT\b|\bTABLESAMPLE\b|USING\s+SAMPLE", upper), name
        if not name.startswith("sample"):
            assert not re.search(r"WHERE[^;]*\bMOD\(|%\s*\d+\s*=", upper), name
