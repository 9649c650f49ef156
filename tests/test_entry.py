"""The registry can be read before any session runs, and with the training-data operators absent."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql().keys() - e.queries().keys()))"


def counted(folder):
    out = subprocess.run([sys.executable, "-c", SAY], cwd=folder, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True)
    return [int(x) for x in out.stdout.split()[-2:]]


def test_registry(tmp_path):
    every, strays = counted(ROOT)
    shutil.copytree(ROOT / "inkgauge", tmp_path / "inkgauge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    fewer, none = counted(tmp_path)
    assert strays == none == 0 and 60 <= fewer <= every
