"""Every query with SQL equals it over the smallest tables; the others run."""

import pytest

from phasewell.plans import catalogue


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, small, same, name):
    df = catalogue.QUERIES[name](spark, small)
    if name in catalogue.ORACLE_SQL:
        same(df, catalogue.ORACLE_SQL[name], small)
    else:
        assert df.count() > 0


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sizes_above_the_largest_unit_of_the_sql(spark, same, tmp_path):
    parts = [(999_999, 24), (999_999, 25), (1_000_001, 25), (1_199_999, 50), (0, 1)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/written")
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "part.parquet")
    same(catalogue.QUERIES["size_pretty"](spark, str(tmp_path)), catalogue.ORACLE_SQL["size_pretty"], tmp_path)
