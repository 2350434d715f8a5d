import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry_points

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_the_library_stands_without_the_training_data_operators(tmp_path):
    """A copy without those folders imports and lists the other queries."""
    code = f"""
import shutil, sys
shutil.copytree({str(ROOT / "quillstone")!r}, {str(tmp_path / "quillstone")!r}, ignore=shutil.ignore_patterns("llm"))
shutil.copy({str(ROOT / "__spark_entry__.py")!r}, {str(tmp_path)!r})
sys.path[:] = [{str(tmp_path)!r}] + [p for p in sys.path if p not in ({str(ROOT)!r}, "")]
import __spark_entry__ as e
assert e.__file__.startswith({str(tmp_path)!r})
assert len(e.queries()) > 60 and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in e.queries())
"""
    import os

    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
