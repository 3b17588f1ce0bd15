import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tests-")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {name} as select * from '{data}/{name}.parquet'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return "~"
    if isinstance(x, float):
        return repr(round(x, 5) + 0.0)
    return str(x)


@pytest.fixture(scope="session")
def same(spark, data, duck):
    """Whether a query and its SQL give the same columns and rows."""
    def check(name, query, sql):
        df = query(spark, data)
        columns = sorted(df.columns)
        got = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
        result = duck.execute(sql)
        names = [c[0] for c in result.description]
        assert sorted(names) == columns, name
        order = [names.index(c) for c in columns]
        want = sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
        assert got == want, (name, [p for p in zip(got, want) if p[0] != p[1]][:3], len(got), len(want))

    return check
