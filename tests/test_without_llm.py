"""The library without its training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_the_rest_works_without_the_subpackage(tmp_path):
    """Only wayfold/llm and tests/llm go: corpus_pipeline.py stays, or goes with them."""
    for gone in (("llm",), ("llm", "corpus_pipeline.py")):
        to = tmp_path / str(len(gone))
        shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
        code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=to, check=True, env=os.environ | {"PYTHONPATH": str(to)}, timeout=120)
