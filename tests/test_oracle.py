"""Every query of the library that has SQL gives the rows of that SQL, and every other one runs."""

import pytest
from compare import rows_of

import rillstone.queries as library

library.load()


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_matches_sql(spark, sf, duck, name):
    found = library.QUERIES[name](spark, sf)
    expected = duck.sql(library.SQL[name])
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.SQL)))
def test_runs(spark, sf, name):
    assert library.QUERIES[name](spark, sf).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_schema_diff_takes_ties_in_order_of_customers(spark, tmp_path):
    """Customers 1 and 121 have id 2 at the first place of two nations, as u16 and u32; 841 of nation 20 as u16."""
    for n, rows in enumerate(([(1, 3), (121, 2), (841, 20)], [(1, 2), (121, 3), (841, 20)])):
        spark.createDataFrame(rows, "c_custkey long, c_nationkey long").coalesce(1).write.parquet(str(tmp_path / f"{n}/customer.parquet"))
        assert library.QUERIES["d_schema_diff"](spark, str(tmp_path / str(n))).collect() == []
