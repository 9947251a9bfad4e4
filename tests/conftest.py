import glob
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def matches(spark, sf_dir):
    """Does a query give the rows of its SQL? Numbers are compared to nine digits."""
    import duckdb

    def norm(v):
        if isinstance(v, float):
            return float(f"{v:.9g}") if v == v else None
        return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v

    def run(query, sql):
        df = query(spark, sf_dir)
        columns = sorted(df.columns)
        ours = sorted(repr(tuple(map(norm, r))) for r in df.select(*columns).collect())
        c = duckdb.connect()
        c.execute("SET TimeZone='UTC'")
        for f in glob.glob(f"{sf_dir}/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        r = c.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        at = [names.index(n) for n in columns]
        assert ours == sorted(repr(tuple(norm(x[i]) for i in at)) for x in r.fetchall())

    return run
