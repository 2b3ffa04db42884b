import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from glyphloom.session import build_session

    s = build_session("tests", "local[4]", {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    """A value both engines print alike."""
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return repr({k: plain(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    if type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return repr(v)


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """Runs a registered query and its SQL over the smallest data; returns the rows of both."""

    def run(name, queries, sql):
        df = queries[name](spark, sf)
        cols = sorted(df.columns)
        ours = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
        rel = duck.sql(sql[name])
        at = [rel.columns.index(c) for c in cols] if sorted(rel.columns) == cols else []
        theirs = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
        return cols, sorted(rel.columns), ours, theirs

    return run
