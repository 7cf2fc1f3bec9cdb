"""The entry module without the corpus package."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
SCRIPT = "import __spark_entry__ as e; print(len(e.queries()), sorted(set(e.oracle_sql()) - set(e.queries())))"


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_works_without_the_corpus_package(tmp_path, pipeline):
    from reviewsieve.registry.queries import QUERIES

    skipped = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(REPO / "reviewsieve", tmp_path / "reviewsieve", ignore=skipped)
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    if pipeline and (REPO / "corpus_pipeline.py").exists():
        shutil.copy(REPO / "corpus_pipeline.py", tmp_path)
    out = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=120
    )
    assert out.stdout.split() == [str(len(QUERIES)), "[]"], out.stderr[-2000:]
