from __future__ import annotations


def test_entry_contract(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert "shift_share_z" in queries
    assert entry.entry(spark).schema.names == ["c", "t", "z_level", "z_asinh", "active"]
