import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TESTDATA = Path(os.environ.get("TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB connections with the test tables as views, by scale."""
    import duckdb

    def connect(sf: str = "sf0.001"):
        c = duckdb.connect()
        c.execute("SET TimeZone='UTC'")
        for p in sorted((TESTDATA / sf).iterdir()):
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
        return c

    return connect


@pytest.fixture(scope="session")
def same(spark, duck):
    """Assert that a query's rows equal those of its SQL."""

    def check(name: str, sf: str = "sf0.001"):
        import __spark_entry__ as entry

        df = entry.queries()[name](spark, str(TESTDATA / sf))
        cols = sorted(df.columns)
        got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
        found = duck(sf).sql(entry.oracle_sql()[name])
        assert sorted(found.columns) == cols
        want = sorted(map(repr, found.project(", ".join(f'"{c}"' for c in cols)).fetchall()))
        assert got == want

    return check
