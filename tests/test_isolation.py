"""The library without its optional part: what is left imports, registers its queries and runs them."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CHECK = """
import __spark_entry__ as e
from gleaner.plans import registry
assert set(e.queries()) == set(registry.QUERIES), set(e.queries()) ^ set(registry.QUERIES)
assert e.oracle_sql() == registry.ORACLES
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_optional_part(tmp_path, pipeline):
    """With the folder removed, and with or without the pipeline that is made of it."""
    skip = ["llm", ".git", "__pycache__"] + ([] if pipeline else ["corpus_pipeline.py"])
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(*skip))
    ran = subprocess.run([sys.executable, "-c", CHECK], cwd=tmp_path / "repo", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert ran.returncode == 0, ran.stderr


def test_nothing_else_imports_the_optional_part():
    others = [p for p in (ROOT / "gleaner").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert others and not [p for p in others if "gleaner.llm" in p.read_text() or "corpus_pipeline" in p.read_text()]
