"""The entry works without the training-data operators and their pipeline."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
ASK = """
import json, __spark_entry__ as e
names = sorted(e.queries())
print("NAMES" + json.dumps([names, sorted(set(e.oracle_sql()) - set(names))]))
"""


def _names(folder) -> tuple[list[str], list[str]]:
    said = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, check=True)
    return tuple(json.loads(said.stdout.rpartition("NAMES")[2]))


def test_entry_without_operators(tmp_path):
    full, extra = _names(REPO)
    assert not extra
    without = shutil.ignore_patterns("llm", "corpus_pipeline.py", "__pycache__", ".git", ".*_cache")
    shutil.copytree(REPO, tmp_path / "copy", ignore=without)
    rest, extra = _names(tmp_path / "copy")
    assert not extra
    assert rest == [n for n in full if n != "pipeline" and not (n.startswith("op") and n[2].isdigit())]
    assert len(rest) >= 157
