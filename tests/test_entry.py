import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_entry_has_rows(spark, data):
    df = entry.entry(spark)
    assert df.columns == ["text_id", "rank", "pos"]
    assert df.limit(1).count() == 1


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_need_the_training_data_package(tmp_path):
    """A copy without that package and the pipeline imports, and has the other queries."""
    import shutil

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "suffloom", tmp_path / "suffloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sa_documents' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert run.returncode == 0, run.stderr
