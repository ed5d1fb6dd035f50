import os

import pytest

os.environ.setdefault("PYSPARK_PYTHON", "python")
os.environ.setdefault("TZ", "UTC")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SMALL}/{t}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if x != x else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


@pytest.fixture(scope="session")
def agree(spark, duck, small):
    """Compares a registered query with its SQL, whatever the order of rows and columns."""

    def run(query, sql):
        df = query(spark, small)
        order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
        mine = sorted((tuple(_plain(r[i]) for i in order) for r in df.collect()), key=repr)
        rel = duck.sql(sql)
        order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
        theirs = sorted((tuple(_plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
        assert sorted(df.columns) == sorted(rel.columns)
        assert mine == theirs

    return run
