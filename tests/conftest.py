import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    place = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.local.dir", place)
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"{place}/warehouse").config("spark.checkpoint.dir", f"{place}/shared")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def same():
    """Asserts that a Spark result and a DuckDB query give the same rows."""

    def check(df, sql, duck):
        found = duck.execute(sql)
        columns = sorted(d[0] for d in found.description)
        place = [[d[0] for d in found.description].index(c) for c in columns]
        assert columns == sorted(df.columns)
        want = sorted(tuple(str(r[k]) for k in place) for r in found.fetchall())
        assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == want

    return check
