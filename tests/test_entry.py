"""The driver's contract, with and without the optional operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


def test_entry_imports_without_the_optional_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['factorloom.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 80; assert not any(k.startswith('op1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_the_library_does_not_import_them():
    for path in (ROOT / "factorloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
