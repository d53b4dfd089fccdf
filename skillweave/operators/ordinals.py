"""Ordinals of a sorted table without one task that holds it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweave.session import written


def with_ordinals(rows: DataFrame, by: str, name: str = "ord") -> DataFrame:
    """``rows`` with their place (from 1) in the order of ``by``, equal values in the order of the other columns.

    The table is dealt into ranges of ``by``, written, and numbered range by range; each range starts after those
    before. Only the ranges' row counts reach the driver."""
    placed = written(rows.repartitionByRange(by).withColumn("range_", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for number, n in sorted(placed.groupBy("range_").count().collect()):
        offsets += [F.lit(number), F.lit(before).cast("long")]
        before += n
    if not offsets:
        return rows.withColumn(name, F.lit(None).cast("long"))
    others = [c for c, t in rows.dtypes if c != by and not t.startswith("map")]
    within = F.row_number().over(Window.partitionBy("range_").orderBy(by, *others))
    return placed.withColumn(name, F.element_at(F.create_map(*offsets), F.col("range_")) + within).drop("range_")
