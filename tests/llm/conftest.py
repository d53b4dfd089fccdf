import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.001"

ODD_TEXTS = [None, "", " \t\n\r", "\n\n", "a", "Ünïcode wörds ÄÖ 漢字 1234567890 " * 3, "x" * 5000, "The the\nTHE the  the",
             "word " * 3000, "line one is rather long here\n" * 4 + "tail", "AİΣ mixed Σ \x1c end"]


@pytest.fixture
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [(i, t, "en", "s%d" % (i % 3), 0, i, "x", 1.0) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[3], rows[5], (5, "other text under the same id", "en", None, 0, 1, "x", 1.0),
             (None, "no id but a rather long line of text", None, None, None, None, None, None),
             (None, None, None, None, None, None, None, None), (100, ODD_TEXTS[9], "en", "s1", 0, 7, "y", 2.0),
             (101, ODD_TEXTS[9], "en", "s1", 0, 7, "y", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "row_key long, size string, score double")
