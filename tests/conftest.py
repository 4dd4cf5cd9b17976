import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


CONN_SCHEMA = (
    "ts double, uid string, id_orig_h string, id_resp_h string, id_resp_p int, "
    "conn_state string, orig_bytes bigint"
)


@pytest.fixture
def conn(spark):
    """Connection frame from partial rows; what a row leaves out has a plain default."""

    def make(rows, schema=CONN_SCHEMA):
        defaults = {
            "ts": 0.0,
            "uid": "u",
            "id_orig_h": "10.0.0.1",
            "id_resp_h": "10.0.0.2",
            "id_resp_p": 22,
            "conn_state": "S0",
            "orig_bytes": 0,
        }
        names = [field.split()[0] for field in schema.split(", ")]
        data = [tuple({**defaults, **row}[name] for name in names) for row in rows]
        return spark.createDataFrame(data, schema)

    return make


def rows_of(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)
