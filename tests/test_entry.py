import __spark_entry__


def test_entry_has_rows_and_sql_names_queries(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
