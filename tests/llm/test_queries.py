"""The ten queries over the whole small tables: against their SQL, or their own invariants."""

import re

import pytest

from tables import SF
from parley.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_is_its_sql(name, agrees):
    agrees(queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE_SQL])
def test_other_queries_run(name, spark):
    df = queries.QUERIES[name](spark, SF if name != "op10_secrets" else SF.replace("0.001", "0.01"))  # the least tables hold no secret
    assert df.count() > 0 and "doc_id" in df.columns


def test_secrets_of_the_given_tables(spark):
    """All assigned hex tokens of the documents, found by a plain pattern, and nothing else."""
    d = SF.replace("0.001", "0.01")
    want = set()
    for r in spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text").collect():
        want |= {(r["doc_id"], m) for m in re.findall(r'(?:token|secret|password|key) ?[:=] ?"([0-9a-f]{32,64})"', r["text"])}
    assert {(r["doc_id"], r["secret"]) for r in queries.QUERIES["op10_secrets"](spark, d).collect()} == want != set()


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2] / "parley"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p


def test_no_local_checkpoints_and_no_swallowed_imports():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2]
    for p in [*(root / "parley").rglob("*.py"), root / "corpus_pipeline.py"]:
        assert "localCheckpoint" not in p.read_text() and "ImportError" not in p.read_text(), p
