"""Number formatting that matches Python's ``format(x, '.Nf')``.

``format_string('%.2f')`` rounds the decimal form half-up (0.625 -> 0.63); Python
rounds the exact binary value half-even (0.625 -> 0.62). ``format_number`` does
the latter, but groups thousands with commas, which are removed here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(c, places: int) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.format_number(col, places), ",", "")
