def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    from oracle_queries import ORACLE
    from shiftscope.queries import REGISTRY
    assert set(REGISTRY) == set(ORACLE)
    assert set(REGISTRY) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_every_query_plans(spark):
    """Every registered query builds a plan on the smallest data (execution is covered by
    tools/compare.py against the DuckDB oracle)."""
    from shiftscope.queries import REGISTRY
    for name, fn in REGISTRY.items():
        assert fn(spark, "/root/testdata/sf0.001").columns, name
