"""Every query of the catalogue against its SQL on the smallest tables."""

import duckdb
import pytest

from lexiloom.operators import catalog, relational

QUERIES = catalog.QUERIES | relational.QUERIES
SQL = catalog.SQL | relational.SQL


def value(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in ("supplier", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, sf_dir, duck, name):
    found, want = QUERIES[name](spark, sf_dir), duck.sql(SQL[name])
    order = sorted(found.columns)
    assert order == sorted(want.columns)
    rows = sorted(repr(tuple(value(r[c]) for c in order)) for r in found.collect())
    assert rows == sorted(repr(tuple(map(value, r))) for r in want.select(*order).fetchall())


@pytest.mark.parametrize("name", ["kernel_select", "kernel_map", "kernel_setparent", "kernel_remcohort"])
def test_kernel_of_long_conversations(spark, tmp_path, name):
    """Turns of two and three digits keep their labels."""
    roles = ["system", "user", "assistant", "user", "user", "assistant"]
    rows = [(c, t, roles[(t + c) % 6], "x" * (150 + 10 * t)) for c in (1, 2) for t in [*range(25), 100, 117]]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(SQL[name]).select("doc_id", "tokens").fetchall()
    assert sorted((r.doc_id, r.tokens) for r in QUERIES[name](spark, str(tmp_path)).collect()) == sorted(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
