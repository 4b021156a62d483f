import glob
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.path.dirname(os.path.abspath(__file__)), ""]) + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from tkanyna.session import session

    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path


@pytest.fixture(scope="session")
def duck(folder):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, folder, duck):
    """Whether a query gives the rows of its SQL."""

    def rows(frame):
        frame = frame[sorted(frame.columns)]
        return sorted(tuple("NULL" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))

    def check(query, sql):
        ours, theirs = query(spark, folder).toPandas(), duck.execute(sql).fetch_df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert rows(ours) == rows(theirs)

    return check
