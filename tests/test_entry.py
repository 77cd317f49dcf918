from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    got = entry.entry(spark).collect()
    assert len(got) == 10 and [r.total for r in got] == sorted((r.total for r in got), reverse=True)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_queries_stay_where_the_others_cannot_be_imported(tmp_path):
    """The subpackage gone but for an empty folder, or a library of it missing: the core queries are all there."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("epochal", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{root}/{name}") else shutil.copy)(f"{root}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "epochal" / "llm", ignore_errors=True)
    (tmp_path / "epochal" / "llm" / "__pycache__").mkdir(parents=True)
    said = "import __spark_entry__ as e; from epochal.queries import QUERIES; assert set(QUERIES) <= set(e.queries()); print(len(e.queries()) - len(QUERIES))"
    gone = subprocess.run([sys.executable, "-B", "-c", said], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert gone.returncode == 0 and gone.stdout.strip() == "0", gone.stderr
    missing = subprocess.run([sys.executable, "-B", "-c", "import sys; sys.modules['zstandard'] = None; " + said], cwd=root, env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True)
    assert missing.returncode == 0 and missing.stdout.strip() == "0", missing.stderr
