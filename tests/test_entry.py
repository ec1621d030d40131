import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query_id", "doc_idx", "distance", "rank"] and df.groupBy("query_id").count().where("count <> 10").count() == 0 < df.count()
    q = e.queries()
    assert set(e.oracle_sql()) <= set(q) and all(map(callable, q.values()))


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """As after deletion of the subpackage: a copy of the repository without it still lists the other queries."""
    import shutil

    at = tmp_path / "copy"
    shutil.copytree(REPO, at, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'scan_topk' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op1')]; print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "fine" in out.stdout, out.stderr
