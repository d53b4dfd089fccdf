"""Concept (taxonomy) reader: JSON array of {uri, pref_label, alt_labels?, definition?}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillweave.operators.ordinals import with_ordinals

CONCEPT = T.StructType([
    T.StructField("uri", T.StringType(), False),
    T.StructField("pref_label", T.StringType(), False),
    T.StructField("alt_labels", T.ArrayType(T.StringType()), True),
    T.StructField("definition", T.StringType(), True),
])


def read_concepts(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Concepts with alt_labels defaulting to []; ``ord`` = rank of the URI (tie-break order).

    The rank is found range by range (``ordinals``), so a taxonomy of any size
    is numbered by many tasks.
    """
    raw = spark.read.schema(CONCEPT).option("multiLine", multiline).json(path)
    return with_ordinals(raw.select(
        "uri", "pref_label", F.coalesce("alt_labels", F.array().cast("array<string>")).alias("alt_labels"),
        "definition"), "uri")
