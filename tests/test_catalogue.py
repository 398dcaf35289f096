import duckdb
import pytest

from quern.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(name, spark, sf_dir, same_as_duckdb):
    same_as_duckdb(QUERIES[name](spark, sf_dir), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _same_over(lines, name, spark, folder):
    """name over lineitem rows (l_orderkey, l_partkey, l_linenumber, l_quantity), against its SQL."""
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(str(folder / "lineitem.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/lineitem.parquet/*.parquet')")
    relation = connection.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, str(folder)).select(*relation.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(relation.fetchall(), key=repr)


def test_ends_of_ranges_are_rounded_and_missing_ones_come_last(spark, tmp_path):
    # ends at 1012.5, 2013.5 and 3000.96; of equal starts, the one without an end is second
    lines = [(1, 0, 1, 1.0 + 1 / 24), (1, 0, 2, 1.125), (1, 0, 3, 0.08), (2, 0, 1, 2.0), (2, 500, 1, None), (2, 500, 1, 3.0), (2, None, 1, 1.0), (None, 0, 1, 4.0), (None, 0, 1, None)]
    _same_over(lines, "merge_ranges", spark, tmp_path)


def test_offsets_that_are_missing_or_of_no_file_stay(spark, tmp_path):
    lines = [(1, 0, 1, 1.125), (1, 100, 1, 3.0), (1, None, 1, 1.0), (2, 0, 1, None), (2, 300, 1, 2.0), (None, 0, 1, 4.0), (None, 300, 1, 1.0), (None, None, 2, 1.0)]
    _same_over(lines, "offset_map", spark, tmp_path)
