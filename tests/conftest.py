import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    if not DATA.exists():
        pytest.skip("test tables are not here")
    return str(DATA)


@pytest.fixture(scope="session")
def duck(folder):
    import duckdb

    con = duckdb.connect()
    for p in Path(folder).iterdir():
        if p.suffix == ".parquet":
            con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.fixture(scope="session")
def same(spark, folder, duck):
    """Compares a query with its SQL, without regard to row order."""

    def cell(v):
        return repr(round(v, 6)) if isinstance(v, float) else str(v)

    def check(query, sql):
        df = query(spark, folder)
        cols = sorted(df.columns)
        got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
        cur = duck.execute(sql)
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        want = sorted(tuple(cell(r[names.index(c)]) for c in cols) for r in cur.fetchall())
        assert got == want

    return check
