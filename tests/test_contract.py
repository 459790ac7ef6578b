"""The entry module imports and answers with or without the optional parts."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_optional_parts(tmp_path):
    import shutil

    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 90 and not [k for k in q if k.startswith('op1')]; import bench"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)


def test_rows_of_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).collect()) > 0
