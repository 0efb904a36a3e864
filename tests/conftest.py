import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lakeload.session import build_session, shared_folder


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def schema(spark, tmp_path):
    """A new schema for the tables of one test."""
    name = "t_" + shared_folder(spark, "x").rsplit("-", 1)[-1]
    spark.sql(f"CREATE SCHEMA {name} LOCATION '{tmp_path}/wh'")
    return name


@pytest.fixture
def small_splits(spark):
    """Cut files into splits of the given number of bytes for one test."""
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {key: spark.conf.get(key) for key in keys}

    def cut(size: int) -> None:
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")

    yield cut
    for key, value in before.items():
        spark.conf.set(key, value)


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


@pytest.fixture(name="rows")
def rows_fixture():
    return rows
