"""The entry without the optional subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SEEN = """
import __spark_entry__ as entry
names = set(entry.queries())
assert len(names) >= 130 and set(entry.oracle_sql()) <= names
assert not [n for n in names if n == "pipeline" or n[:2] == "op" and n[2].isdigit()]
"""


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_the_rest_imports_without_the_optional_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    done = subprocess.run([sys.executable, "-c", SEEN], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
