"""The driver's contract, with and without the training-data operators."""

import shutil
import subprocess
import sys

import __spark_entry__
from tests.conftest import ROOT


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["word", "n"] and df.count() == 27782


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_stands_alone(tmp_path):
    """Without the subpackage, its tests and the pipeline, everything else still imports."""
    kept = tmp_path / "repo"
    shutil.copytree(ROOT, kept, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n.startswith('op') and n[2:3].isdigit()), len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=kept, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.startswith("[] ")
