"""The library without its training-data subpackage, in a copy of the tree."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def loaded(tree: Path) -> list[str]:
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    run = subprocess.run([sys.executable, "-c", code], cwd=tree, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


def test_queries_load_without_the_training_data_package(tmp_path):
    shutil.copytree(ROOT / "corpusloom", tmp_path / "corpusloom", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path)
    bare = loaded(tmp_path)
    assert "hybrid_search" in bare and "pipeline" not in bare and not any(q.startswith("op") and q[2].isdigit() for q in bare)
    if (ROOT / "corpus_pipeline.py").exists():  # left behind, it is not a query
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        assert loaded(tmp_path) == bare
