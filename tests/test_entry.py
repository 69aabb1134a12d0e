"""The driver's contract: queries against DuckDB, and imports that survive without the training-data subpackage."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from seqloom.plans import queries, sql


def test_names_match():
    assert set(sql.oracle_sql()) <= set(queries.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["normalize", "kmer_code", "collapse_counts", "collapse_quality", "low_complexity_f3", "prefix_stats", "branch_lengths", "read_nodes", "map_e1", "hits_dedup", "sam_unified"])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    want = con.execute(sql.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_imports_without_the_subpackage():
    code = "import sys; sys.modules['seqloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'normalize' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
