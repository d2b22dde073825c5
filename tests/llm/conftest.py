import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from cases import EDGE  # noqa: E402

@pytest.fixture(scope="session")
def edge(spark):
    """Rows with columns whose names clash with the operators' own."""
    rows = [(i, t, "en" if k % 2 else "de", "k", True, k) for k, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, key string, kept boolean, score int").coalesce(2)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.filter("doc_id < 0")
