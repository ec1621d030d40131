"""Every query that SQL can state agrees with DuckDB; the others run and keep their invariants."""

import pytest

from tables import SF
from parley.plans import files, registry  # noqa: F401


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_is_its_sql(name, agrees):
    agrees(registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE_SQL])
def test_query_without_sql_gives_rows(name, spark):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_no_query_reads_a_sample():
    import inspect

    text = inspect.getsource(registry)
    assert ".sample(" not in text and "localCheckpoint" not in text
