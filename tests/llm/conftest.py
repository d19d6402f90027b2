import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows, extra=False):
        """rows of (doc_id, text); extra adds a column whose name clashes with what operators make."""
        full = [(i, t, "en", "s", None if t is None else len(t)) + (("x",) if extra else ()) for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long" + (", words string" if extra else "")
        return spark.createDataFrame(full, schema)

    return make
