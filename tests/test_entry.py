import __spark_entry__


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    out = __spark_entry__.entry(spark)
    assert out.columns == ["query_id", "chunk_id", "score", "pos"] and out.count() > 0
