import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from odd_rows import SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts (ids from 0, or pairs of id and text), with extra columns whose names the operators use too."""

    def build(texts, langs=None):
        rows = []
        for i, t in enumerate(texts):
            doc_id, text = t if isinstance(t, tuple) else (i, t)
            rows.append((doc_id, text, langs[i] if langs else "en", "s", len(text or ""), "label", "token", i, i))
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return build
