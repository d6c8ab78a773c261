"""The rest of the library works without the subpackage ``llm``, its tests, and the pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("gone", [("corpusloom/llm", "tests/llm"), ("corpusloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.md", "*.json"))
    for name in gone:
        at = copy / name
        if at.exists():
            shutil.rmtree(at) if at.is_dir() else at.unlink()
    env = os.environ | {"PYTHONPATH": str(copy), "PYTHONDONTWRITEBYTECODE": "1"}
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); assert len(q) > 50 and 'pipeline' not in q and not any(n.startswith('op') for n in q); print(e.__file__)"
    found = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0 and found.stdout.startswith(str(copy)), found.stderr
    tests = ["tests/test_entry.py::test_every_sql_has_its_query", "tests/test_entry.py::test_entry"]
    run = subprocess.run([sys.executable, "-m", "pytest", "-x", "-q", *tests], cwd=copy, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stdout


def test_nothing_else_imports_it():
    for path in [*(ROOT / "corpusloom").rglob("*.py"), *(ROOT / "tests").glob("*.py")]:
        if "llm" not in path.relative_to(ROOT).parts and path.name != "test_deletion.py":
            assert "corpusloom.llm" not in path.read_text(), path
