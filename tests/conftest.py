import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("scopelens-tests")
        .config("spark.sql.shuffle.partitions", "3")
        # Compiling a plan takes longer than running it on a few rows.
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    return DATA


CASE_COLUMNS = (
    "month date, case_type string, case_group string, reason string, brand string, subcat1 string, "
    "subcat2 string, line string, variant string, channel string"
)


@pytest.fixture
def make_cases(spark):
    """Cases from dicts; what a row leaves out is NULL, the month is January 2024."""
    from datetime import date

    names = [part.split()[0] for part in CASE_COLUMNS.split(", ")]

    def make(*rows):
        filled = []
        for row in rows:
            row = {"month": "2024-01", **row}
            year, month = map(int, row["month"].split("-")) if row["month"] else (None, None)
            row["month"] = date(year, month, 1) if year else None
            filled.append(tuple(row.get(name) for name in names))
        return spark.createDataFrame(filled, CASE_COLUMNS)

    return make


@pytest.fixture
def make_counts(spark):
    def make(*rows, name="label"):
        return spark.createDataFrame(list(rows), f"{name} string, total long")

    return make


def tuples(df):
    return [tuple(row) for row in df.collect()]
