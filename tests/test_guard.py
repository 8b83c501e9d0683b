"""The entry module works without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_llm(tmp_path, pipeline):
    """Both folders gone, with the pipeline's module left behind or gone too: the entry works and all other tests load."""
    shutil.copytree(REPO / "quern", tmp_path / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(REPO / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", "pytest.ini", *(["corpus_pipeline.py"] if pipeline and (REPO / "corpus_pipeline.py").exists() else [])):
        shutil.copy(REPO / name, tmp_path)
    code = textwrap.dedent("""
        import __spark_entry__ as e
        q = e.queries()
        assert "pipeline" not in q and not any(n.startswith("op") and n[2].isdigit() for n in q) and "calc_snn" in q
        assert set(e.oracle_sql()) <= set(q)
    """)
    # The caller's environment, which may be where the tests' modules come from, with the copy before all else on the path.
    path = [x for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x and Path(x).resolve() != REPO]
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(tmp_path), *path]), "PYTHONDONTWRITEBYTECODE": "1"}

    def run(*args):
        done = subprocess.run([sys.executable, *args], cwd=tmp_path, env=env, capture_output=True, text=True)
        assert done.returncode == 0, f"{args}:\n{done.stdout[-4000:]}\n{done.stderr[-4000:]}"
        return done.stdout

    run("-c", code)
    found = run("-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider")
    assert "test_goldens.py" in found and "tests/llm" not in found


def test_sql_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
