"""The entry point with and without the subpackage ``llm`` and the pipeline that is made of it."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from cinderlens import registry

REPO = Path(__file__).parent.parent


@pytest.mark.parametrize("gone", [["cinderlens/llm"], ["cinderlens/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_what_is_left_still_loads(tmp_path, gone):
    shutil.copytree(REPO / "cinderlens", tmp_path / "cinderlens", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path / name)
    for name in gone:
        there = tmp_path / name
        if there.is_dir():
            shutil.rmtree(there)
        elif there.exists():
            there.unlink()
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print('NAMES', *e.queries())"], cwd=tmp_path, capture_output=True, text=True, check=True)
    names = said.stdout.rpartition("NAMES")[2].split()
    assert set(registry.queries()) <= set(names)
    assert "pipeline" not in names
    assert any(x.startswith("op1_") for x in names) == (gone == ["corpus_pipeline.py"] and (REPO / "cinderlens/llm").is_dir())
