import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def make(rows):
        rows = [(i, t, "en", "src0", len(t or ""), 7, "x") for i, t in rows]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, part string"
        return spark.createDataFrame(rows, schema)

    return make
