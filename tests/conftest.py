import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    from quern import reachable

    reachable(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_as_duckdb(sf_dir):
    """Compares a DataFrame with SQL's rows, in any order."""
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")

    def compare(frame, sql):
        relation = connection.sql(sql)
        columns = sorted(relation.columns)
        places = [relation.columns.index(c) for c in columns]
        want = sorted((tuple(r[i] for i in places) for r in relation.fetchall()), key=repr)
        assert sorted(frame.columns) == columns
        got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
        assert got == want

    return compare
