import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def tiny(spark):
    """A table of documents from (doc_id, text) pairs, with extra columns that clash with the operators' own."""
    schema = ("doc_id long, text string, lang string, source string, n_chars long, fingerprint long, score double, block int, "
              "kept boolean, _score double")

    def make(rows):
        return spark.createDataFrame([(i, t, "en", None, None, 1, 2.0, 3, True, 4.0) for i, t in rows], schema)

    return make
