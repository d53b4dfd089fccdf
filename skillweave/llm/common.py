"""Helpers shared by the training-data operators: tables, scratch, word scanning, bounded bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillweave.functions.bitmaps import in_bitmap, slot_bitmap
from skillweave.session import scratch_path

#: Text bytes handled by numpy at a time; a single longer document is handled whole.
SLICE_BYTES = 1 << 20


#: Rows and bytes in an Arrow batch, where the session has Spark's defaults of 10,000 and 64 MB: rows are whole texts.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder. The session's Arrow batches are made smaller, unless the caller has set them."""
    for key, default, own in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(own))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared scratch folder and read again (lineage is cut)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_by_hash(df: DataFrame, order: str, limit: int) -> DataFrame:
    """The ``limit`` rows with the smallest ``order`` (a 64-bit hash). Rows beyond twice the share that the limit
    should need are left out in the scan, so partitions do not each send ``limit`` candidates on."""
    n = df.count()
    if n > 2 * limit:
        df = df.where(F.col(order) < F.lit(-(1 << 63) + int((1 << 64) * 2 * limit / n)))
    return df.orderBy(order, *[c for c in df.columns if c != order and c.endswith("_id")]).limit(limit)


def whole_rows_within(rows: DataFrame, size, bound: int) -> DataFrame:
    """The rows of a bounded sample (with ``ord``, a hash) whose sizes add up to at most ``bound``, in the order of
    ``ord``. Rows are kept whole or not at all; rows of one ``ord`` stay or go together, and those that alone are over
    the bound go. Only sums by ``ord`` are gathered."""
    sums = rows.groupBy("ord").agg(F.sum(size).alias("size")).where(F.col("size") <= bound)
    total = F.sum("size").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = sums.withColumn("total", total).where(F.col("total") <= bound).select("ord")
    return rows.join(F.broadcast(fits), "ord")


def row_key():
    """Tells apart rows that share a doc_id but not a text; identical rows share it."""
    return F.xxhash64("text").alias("row_key")


# ---- whole texts as byte arrays -------------------------------------------------------------------------------

def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column, null as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    return offsets, np.frombuffer(data or b"", dtype=np.uint8)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, a longer row alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _word_bytes() -> np.ndarray:
    """Bytes of words: digits, letters and all bytes of code points from U+0080 on."""
    table_ = np.zeros(256, dtype=bool)
    table_[0x30:0x3A] = table_[0x41:0x5B] = table_[0x61:0x7B] = table_[0x80:] = True
    return table_


WORD = _word_bytes()
_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


class WordScanner:
    """Words of a slice of documents with a 64-bit hash each; powers are kept between slices."""

    def __init__(self) -> None:
        self._up = self._down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            size = max(n, SLICE_BYTES)
            for name, base in (("_up", _BASE), ("_down", _UNBASE)):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def scan(self, offsets: np.ndarray, data: np.ndarray, i: int, j: int):
        """For rows i..j: (start, end, row, hash) of each word; start and end are positions in ``data``,
        row counts from 0 at i."""
        lo, hi = int(offsets[i]), int(offsets[j])
        chunk = data[lo:hi]
        if not len(chunk):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, np.zeros(0, dtype=np.uint64)
        begins = offsets[i:j] - lo
        begins = begins[begins < len(chunk)]
        word = WORD[chunk]
        before = np.empty_like(word)
        before[0], before[1:] = False, word[:-1]
        before[begins] = False
        starts = np.flatnonzero(word & ~before)
        after = np.empty_like(word)
        after[-1], after[:-1] = False, word[1:]
        after[begins[begins > 0] - 1] = False
        ends = np.flatnonzero(word & ~after) + 1
        self._powers(len(chunk))
        total = np.zeros(len(chunk) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[chunk] * self._up[:len(chunk)], out=total[1:])
        h = (total[ends] - total[starts]) * self._down[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        rows = np.searchsorted(offsets[i:j + 1] - lo, starts, side="right") - 1
        return starts + lo, ends + lo, rows, h


# ---- joins that move only what they must ----------------------------------------------------------------------

#: Bits of the largest bitmap (64 MB); one of a few keys takes 8 KB. A key that is not there passes one of 2**SPARE
#: times as many bits with a chance of about one in 2**SPARE.
MOST_BITS, LEAST_BITS, SPARE = 29, 16, 4


def bitmap_bits(n_keys: int) -> int:
    return max(LEAST_BITS, min(MOST_BITS, max(1, n_keys).bit_length() + SPARE))


def _maybe(keys: DataFrame, *columns: str):
    """A function of a hash column: whether it may be that of a row of ``keys``, by a bitmap that grows with them."""
    bitmap = slot_bitmap(keys.select(F.xxhash64(*columns).alias("h")), "h", bitmap_bits(keys.count()))
    shared = keys.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(shared.value, h.to_numpy(dtype=np.int64).astype(np.uint64)))
    return maybe


def perhaps_in(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not in ``keys``; the others need no join."""
    return rows.where(_maybe(keys, column)(F.xxhash64(column)))


def split_rows(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows surely not in ``keys``, rows perhaps in it) of ``docs``, by doc_id and text; ``keys``, a written table, has
    (doc_id, row_key). A bitmap decides in the scan, so only the second part needs a join and moves its texts. The bitmap
    takes 16 to 32 bits for a key up to its bound (MOST_BITS: 32 million keys at that rate, more at a lower one); with
    many times as many keys most texts are perhaps in them and move, which is right and no faster than a join."""
    flag = _maybe(keys, "doc_id", "row_key")(F.xxhash64("doc_id", F.xxhash64("text")))
    return docs.where(~flag), docs.where(flag)


def same_row(docs: DataFrame, other_id: str, other_key: str):
    """Join condition on doc_id (nulls equal) and text key."""
    return docs["doc_id"].eqNullSafe(F.col(other_id)) & (F.xxhash64(docs["text"]) == F.col(other_key))


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not in ``rejected`` (doc_id, row_key)."""
    rejected = written(rejected.select("doc_id", "row_key").distinct(), "rejected")
    sure, perhaps = split_rows(docs, rejected)
    bad = rejected.select(F.col("doc_id").alias("__bad_id"), F.col("row_key").alias("__bad_key"))
    return sure.unionByName(perhaps.join(bad, same_row(perhaps, "__bad_id", "__bad_key"), "left_anti"))
