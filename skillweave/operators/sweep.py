"""Running maxima along an advert's text, in segments.

A sweep over intervals asks at each position how far the intervals that began before reach. Rows are cut into bins of
``bin_chars`` characters by their position; a running maximum inside each bin and the maximum carried over from the bins
before give the same as one run over the advert, but one very long advert is as many tasks as it has bins, and what is
carried is one row for each bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a bin; adverts of ordinary length have one.
BIN_CHARS = 1 << 16


def running_max(rows: DataFrame, position: str, order: list, values: dict[str, Column], bin_chars: int = BIN_CHARS,
                backward: bool = False, peers: bool = True) -> DataFrame:
    """``rows`` (posting_id, ...) with the running maximum of each of ``values`` along ``order``, a list of columns that
    begins with ``position``; from the end of the advert with ``backward``. With ``peers`` rows that are equal in
    ``order`` see each other."""
    held = rows.withColumn("bin_", F.floor(F.col(position) / F.lit(bin_chars)))
    held = held.select("*", *[v.alias(f"own_{n}") for n, v in values.items()])
    inside = Window.partitionBy("posting_id", "bin_").orderBy(*order)
    frame = inside.rangeBetween if peers and len(order) == 1 else inside.rowsBetween
    inside = frame(Window.unboundedPreceding, Window.currentRow)
    before = (Window.partitionBy("posting_id").orderBy(F.desc("bin_") if backward else F.col("bin_"))
              .rowsBetween(Window.unboundedPreceding, -1))
    bins = held.groupBy("posting_id", "bin_").agg(*[F.max(f"own_{n}").alias(n) for n in values])
    carried = bins.select("posting_id", "bin_", *[F.max(n).over(before).alias(f"carried_{n}") for n in values])
    carried = carried.where(" or ".join(f"carried_{n} is not null" for n in values))
    met = held.select(*rows.columns, "bin_", *[F.max(f"own_{n}").over(inside).alias(f"in_{n}") for n in values])
    out = met.join(carried, ["posting_id", "bin_"], "left")
    return out.select(*rows.columns, *[F.greatest(f"in_{n}", f"carried_{n}").alias(n) for n in values])
