import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tables import SF, TABLES  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from parley.session import local_session

    s = local_session(os.environ.get("TEST_CPUS", "4"), **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    """Values as they are compared: floats to nine digits, containers as tuples."""
    if x is None or isinstance(x, (bool, str, bytes)):
        return x
    if isinstance(x, float):
        return float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    if type(x).__name__ == "Decimal":
        return plain(float(x)) if x != int(x) else int(x)
    return x


def bag(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="session")
def agrees(spark, duck):
    """Whether a query's rows over the small tables are those of its SQL."""

    def check(query, sql):
        df = query(spark, SF)
        names = sorted(df.columns)
        rel = duck.sql(sql)
        assert names == sorted(rel.columns)
        got = bag(df.select(*names).collect())
        order = [rel.columns.index(c) for c in names]
        want = bag([tuple(r[i] for i in order) for r in rel.fetchall()])
        assert len(got) == len(want)
        assert got == want

    return check
