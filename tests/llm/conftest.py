import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def llm(spark):
    from urbanloom.scale import ship_package

    ship_package(spark)
    return spark


@pytest.fixture
def documents(llm):
    """Builds a documents table from ``(doc_id, text)`` or ``(doc_id, text, lang, source)`` rows."""

    def build(rows, **more):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), None if r[1] is None else len(r[1])) for r in rows]
        return llm.createDataFrame(full, SCHEMA)

    return build
