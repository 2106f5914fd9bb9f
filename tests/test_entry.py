import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["requirements_by_type", "clause_tree", "uid_columns", "hybrid_fuse", "groundedness", "apply_status_updates"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "part", "lineitem", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    norm = lambda rows: sorted(tuple(str(round(v, 9) if isinstance(v, float) else v) for v in r) for r in rows)
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert norm(tuple(r) for r in got.select(*cols).collect()) == norm(res.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
