import __spark_entry__ as entry


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 90
