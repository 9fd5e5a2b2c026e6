"""The entry module with and without the training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') and k[2].isdigit() for k in e.queries()))"


def without(folder, *gone):
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for g in gone:
        path = folder / g
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_folders_taken_away(tmp_path):
    from quern import catalog

    bare = [str(len(catalog.QUERIES)), str(len(catalog.ORACLES)), "False"]
    assert without(tmp_path / "folders", "quern/llm", "tests/llm") == bare
    assert without(tmp_path / "all", "quern/llm", "tests/llm", "corpus_pipeline.py") == bare
    assert "pipeline" not in catalog.QUERIES and len(__spark_entry__.queries()) >= len(catalog.QUERIES)


def test_nothing_else_imports_them():
    for file in (ROOT / "quern").rglob("*.py"):
        if "llm" not in file.parts:
            assert "quern.llm" not in file.read_text() and "corpus_pipeline" not in file.read_text(), file


def test_what_a_session_leaves(tmp_path):
    """What queries write for themselves goes when the driver ends; nothing else in the shared folder does."""
    (tmp_path / "own").mkdir()
    code = f"""
from pyspark.sql import SparkSession
from quern.sources.shared import fresh
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
spark.range(3).write.parquet(fresh(spark, "some"))
spark.range(3).write.parquet(fresh(spark, "some"))
print(len(list(__import__("pathlib").Path("{tmp_path}").rglob("some-*"))))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=ROOT)
    assert out.stdout.strip().endswith("2"), out.stderr
    assert not list(tmp_path.rglob("*.parquet")) and (tmp_path / "own").is_dir()
