import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from feedloom.llm.common import small_batches  # noqa: E402


@pytest.fixture(autouse=True)
def batches(spark):
    small_batches(spark)


@pytest.fixture
def make_docs(spark):
    """Documents of (doc_id, text, lang, source), with columns whose names could clash."""

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r))) for r in rows]
        shape = "doc_id long, text string, lang string, source string, n_chars long, node int, u int, size string"
        return spark.createDataFrame(
            [(*r, len(r[1]) if r[1] is not None else None, 1, 2, "x") for r in full], shape
        )

    return make
