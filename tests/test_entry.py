"""The driver contract without the pipeline package."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_pipeline_package(tmp_path):
    for name in ("__spark_entry__.py", "webquarry"):
        take = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        extra = {"ignore": shutil.ignore_patterns("llm", "__pycache__")} if (ROOT / name).is_dir() else {}
        take(ROOT / name, tmp_path / name, **extra)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), [n for n in q if n.startswith('op')])"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"}, check=False)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[1:] == ["[]"]
