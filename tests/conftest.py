import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same(spark):
    """Runs a query and its SQL over a folder of tables and compares their rows."""
    import duckdb

    def rows(frame):
        def one(v):
            v = v.item() if hasattr(v, "item") else v
            return "null" if v is None or v != v else repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)

        frame = frame[sorted(frame.columns)]
        return sorted(tuple(one(v) for v in r) for r in frame.itertuples(index=False))

    def check(query, sql, folder):
        con = duckdb.connect()
        for f in os.listdir(folder):
            con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}{'/*.parquet' if os.path.isdir(f'{folder}/{f}') else ''}'")
        got, want = query(spark, str(folder)).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)

    return check
