"""Concept vector cache: a versioned Parquet table keyed by (model_id, uri, label_hash), one row per key.

The table is a set of generations (folders that never change once written) and a log of pointers. A pointer names the
generations that make up one version of the table; the highest one is current. A refresh encodes only the concepts whose
(model, uri, label hash) the current version lacks, writes them as a generation and commits it by creating the next
pointer, which only one writer can. Whoever comes second looks at the new version, leaves out the keys that came with
it, and tries again, so refreshes at the same time leave one row per key. Readers join a version with the current concept
list on the full key, so entries of edited labels are never used (the key includes the label hash, unlike a cache keyed
by the URI list). ``compact`` writes one generation, sorted by key, in place of many; ``vacuum`` removes the folders that
the current version does not name.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillweave.session import get_text, hadoop_path, put_text

KEY = ["model_id", "uri", "label_hash"]
#: A version of more generations is compacted by the next refresh.
MAX_GENERATIONS = 8
#: A pointer still empty after so many seconds was left by a writer that is gone.
POINTER_SECONDS = 10

STORE_SCHEMA = T.StructType([
    T.StructField("model_id", T.StringType()), T.StructField("uri", T.StringType()),
    T.StructField("label_hash", T.StringType()),
    T.StructField("terms", T.MapType(T.StringType(), T.LongType())),
    T.StructField("vec", T.ArrayType(T.DoubleType())),
    T.StructField("norm", T.DoubleType()),
])


# ---- versions ---------------------------------------------------------------------------------------------------

def _pointers(spark: SparkSession, path: str) -> list[int]:
    fs, folder = hadoop_path(spark, f"{path}/_versions")
    if not fs.exists(folder):
        return []
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(folder) if x.getPath().getName().isdigit())


def _content(spark: SparkSession, path: str, number: int) -> list[str] | None:
    """The generations a pointer names, None while it is empty."""
    text = get_text(spark, f"{path}/_versions/{number:010d}")
    return None if text is None else text.split("\n")


def version(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """(number, generations) of the current version; (0, []) of a table that has none yet."""
    until = time.monotonic() + POINTER_SECONDS
    numbers = _pointers(spark, path)
    while numbers:
        names = _content(spark, path, numbers[-1])
        if names is not None:
            return numbers[-1], names
        if time.monotonic() < until:
            time.sleep(0.1)
            numbers = _pointers(spark, path)
        else:
            numbers.pop()
    return 0, []


def _commit(spark: SparkSession, path: str, number: int, names: list[str]) -> bool:
    """Creates a pointer; False if there is one of that number already."""
    fs, p = hadoop_path(spark, f"{path}/_versions/{number:010d}")
    try:
        if not fs.createNewFile(p):
            return False
    except Exception:
        if fs.exists(p):  # another writer made it between the look and the creation
            return False
        raise
    put_text(spark, f"{path}/_versions/{number:010d}", "\n".join(names))
    return True


def _write(rows: DataFrame, path: str) -> str:
    name = f"generation-{uuid.uuid4().hex}"
    rows.select(*[f.name for f in STORE_SCHEMA.fields]).write.parquet(f"{path}/{name}")
    return name


def _rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], STORE_SCHEMA)
    return spark.read.schema(STORE_SCHEMA).parquet(*[f"{path}/{n}" for n in names])


def table(spark: SparkSession, path: str) -> DataFrame:
    """All entries of the current version."""
    return _rows(spark, path, version(spark, path)[1])


def compact(spark: SparkSession, path: str) -> None:
    """The current version as one generation, sorted by key; nothing happens if another writer comes first."""
    number, names = version(spark, path)
    if len(names) > 1:
        rows = _rows(spark, path, names).repartition("uri").sortWithinPartitions(*KEY)
        _commit(spark, path, _next(spark, path, number), [_write(rows, path)])


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes the generations that the current version does not name; returns how many. For a time without writers, and
    without readers of older versions."""
    names = set(version(spark, path)[1])
    fs, folder = hadoop_path(spark, path)
    old = [x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().startswith("generation-")
           and x.getPath().getName() not in names]
    for p in old:
        fs.delete(p, True)
    return len(old)


def _next(spark: SparkSession, path: str, number: int) -> int:
    """The number after ``number``, and after the pointers that were left empty."""
    return max([number, *(n for n in _pointers(spark, path) if n > number and _content(spark, path, n) is None)]) + 1


# ---- the cache --------------------------------------------------------------------------------------------------

def keyed(concepts: DataFrame, model_id: str) -> DataFrame:
    return concepts.select(F.lit(model_id).alias("model_id"), "uri", "pref_label",
                           F.sha2("pref_label", 256).alias("label_hash"))


def refresh(spark: SparkSession, path: str, concepts: DataFrame, model_id: str,
            encode: Callable[[DataFrame], DataFrame]) -> int:
    """Encodes and adds the missing (model, uri, label) entries; returns how many."""
    number, names = version(spark, path)
    missing = (keyed(concepts, model_id).dropDuplicates(KEY)
               .join(_rows(spark, path, names).select(*KEY), KEY, "left_anti"))
    if missing.isEmpty():  # of the labels; the encoder runs once, in the write
        return 0
    new = _write(encode(missing), path)
    while not _commit(spark, path, _next(spark, path, number), [*names, new]):
        number, names = version(spark, path)
        left = _rows(spark, path, [new]).join(_rows(spark, path, names).select(*KEY), KEY, "left_anti")
        if left.isEmpty():
            return 0
        new = _write(left, path)
    if len(names) + 1 > MAX_GENERATIONS:
        compact(spark, path)
    return _rows(spark, path, [new]).count()


def current_vectors(spark: SparkSession, path: str, concepts: DataFrame, model_id: str) -> DataFrame:
    """Cache entries valid for the current concept labels."""
    cur = keyed(concepts, model_id).select(*KEY)
    return table(spark, path).join(cur, KEY, "left_semi")


def dense_encoder(model_id: str, encode_batch) -> Callable[[DataFrame], DataFrame]:
    """Encoder for the cache from ``encode_batch(list of texts) -> vectors`` (unit-normalised by the slot)."""
    from skillweave.operators.encode import encoder_slot

    def encode(missing: DataFrame) -> DataFrame:
        keyed_ = missing.select(F.concat_ws("\u0001", "uri", "label_hash").alias("key"), F.col("pref_label").alias("text"))
        parts = F.split("key", "\u0001")
        return encoder_slot(keyed_, encode_batch, "key", "text", model_id).select(
            "model_id", parts[0].alias("uri"), parts[1].alias("label_hash"),
            F.lit(None).cast("map<string,bigint>").alias("terms"), "vec", F.lit(1.0).alias("norm"))

    return encode


def trigram_encoder(model_id: str = "trigram") -> Callable[[DataFrame], DataFrame]:
    """Sparse encoder for the cache: term counts of padded lower-cased trigrams."""
    from skillweave.operators.match import trigrams

    def encode(missing: DataFrame) -> DataFrame:
        grams = missing.select("uri", "label_hash", F.explode(trigrams(F.col("pref_label"))).alias("gram"))
        tf = grams.groupBy("uri", "label_hash", "gram").agg(F.count("*").alias("tf"))
        return tf.groupBy("uri", "label_hash").agg(
            F.map_from_entries(F.collect_list(F.struct("gram", "tf"))).alias("terms"),
            F.sqrt(F.sum(F.col("tf") * F.col("tf")).cast("double")).alias("norm")).select(
            F.lit(model_id).alias("model_id"), "uri", "label_hash", "terms", F.lit(None).cast("array<double>").alias("vec"),
            "norm")

    return encode
