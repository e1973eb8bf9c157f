"""Small document tables with the awkward cases."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from texts, numbered from 0; a row may be a tuple of doc_id and text."""

    def make(*texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(k, t, "en", "src", len(t or "")) for k, t in rows], SCHEMA)

    return make
