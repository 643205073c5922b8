"""The entry without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def listed(before: str) -> list[str]:
    code = f"import sys\n{before}\nimport __spark_entry__ as e\nprint(*e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    return said.stdout.split()


def test_other_queries_stand_alone():
    others = listed("sys.modules['triagelake.llm'] = None")
    assert "rule_profile" in others and "pipeline" not in others
    assert not [name for name in others if name.startswith("op1_")]
    assert listed("sys.modules['corpus_pipeline'] = None") == others


def test_nothing_else_imports_the_operators():
    for folder in ("triagelake", "checks", "tests"):
        for path in (ROOT / folder).rglob("*.py"):
            if "llm" not in path.parts and path.name != "test_guard.py":
                assert "triagelake.llm" not in path.read_text(), path
