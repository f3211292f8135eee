import __spark_entry__ as e


def test_registry():
    q, sql = e.queries(), e.oracle_sql()
    assert len(q) >= 40 and set(sql) <= set(q)


def test_entry(spark):
    df = e.entry(spark)
    assert df.count() > 0 and "final_rank" in df.columns
