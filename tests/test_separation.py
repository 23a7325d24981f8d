"""The library without the folders that may be deleted."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import __spark_entry__ as entry
names = entry.queries()
assert len(names) > 60 and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names), names
assert set(entry.oracle_sql()) <= set(names)
"""


def without(tmp_path, *gone):
    there = tmp_path / "repo"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for x in gone:
        shutil.rmtree(there / x) if (there / x).is_dir() else (there / x).unlink(missing_ok=True)
    return there


def run(there, *args):
    return subprocess.run([sys.executable, "-B", *args], cwd=there, env=os.environ | {"PYTHONPATH": str(there)}, capture_output=True, text=True, timeout=300)


def test_entry_without_the_folders(tmp_path):
    there = without(tmp_path, "vantor/llm", "tests/llm", "corpus_pipeline.py")
    done = run(there, "-c", SCRIPT)
    assert done.returncode == 0, done.stderr
    done = run(there, "-m", "pytest", "--collect-only", "-q", "tests")
    assert done.returncode == 0, done.stdout


def test_entry_with_the_pipeline_alone(tmp_path):
    done = run(without(tmp_path, "vantor/llm", "tests/llm"), "-c", SCRIPT)
    assert done.returncode == 0, done.stderr
