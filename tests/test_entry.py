"""The driver's entry with and without the training-data operators, and scratch tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from rankloom.scratch import dropped, scope, written

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_training_data_operators(tmp_path, pipeline):
    """Both folders gone: everything else is registered and imports, whether or not the pipeline's file is left."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", *([] if pipeline else ["corpus_pipeline.py"])))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'flagship' in q and set(s) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) > 80, done.stderr[-2000:]


def test_scratch_tables(spark):
    table = written(spark.range(5), "test")
    path = Path(table._scratch_path.removeprefix("file:"))
    assert table.count() == 5 and path.exists()
    dropped(table, None, spark.range(1))
    assert not path.exists()


def test_scopes_keep_what_they_are_told_to(spark):
    with scope() as keep:
        with scope() as keep_inner:
            one, two = keep_inner(written(spark.range(2), "test")), written(spark.range(3), "test")
        assert two._scratch_path is None and one.count() == 2
        three = keep(written(spark.range(4), "test"))
    assert one._scratch_path is None and three.count() == 4
    dropped(three)
