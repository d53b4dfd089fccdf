"""The consolidation fold as a merge of segment summaries.

The fold walks the rows of a group in order and keeps a winner: a row replaces it if its score is strictly higher, or if
the winner is nice-to-have and the row is a must. It is no arg-max, but what a segment of rows does to any winner that
enters it is told by three things:

* ``top``, its highest score: a winner below that is always replaced, and then by the row ``low`` at the end;
* ``nice``, the row at the end when a nice-to-have winner of ``top`` or more enters (none if the segment has no must);
* any other winner stays.

Two neighbouring summaries make one of the same size, and this is associative. So a group is cut into chunks by its
order column, each chunk becomes one summary, and a group's summaries are merged in order: no list of a group is ever
held, and a group of any size is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of the order column in a chunk.
CHUNK = 4_096
_STATE = "first_ord long, top double, low_score double, low_must boolean, low_id string, nice_score double, " \
         "nice_must boolean, nice_id string"


def merged(run: np.ndarray, top: np.ndarray, low: np.ndarray, nice: np.ndarray, score: np.ndarray,
           must: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One summary (first place, top, low, nice) for each run of equal, neighbouring ``run`` numbers.

    ``low`` and ``nice`` are numbers of rows (-1: none) in ``score`` and ``must``. Neighbours are merged pairwise, all
    runs at once, until each run is one summary."""
    place = np.arange(len(run))

    def enter(top_, low_, nice_, row):
        """The row at the end of a segment that ``row`` enters."""
        kept = np.where(~must[row] & (nice_ >= 0), nice_, row)
        return np.where(score[row] < top_, low_, kept)

    while len(run) > 1 and (run[1:] == run[:-1]).any():
        first = np.searchsorted(run, run)
        left = np.flatnonzero(((np.arange(len(run)) - first) % 2 == 0) & np.append(run[1:] == run[:-1], False))
        right = left + 1
        low_ = np.where(top[right] > top[left], low[right], enter(top[right], low[right], nice[right], low[left]))
        nice_ = np.where(nice[left] >= 0, enter(top[right], low[right], nice[right], nice[left]), nice[right])
        top, low, nice = top.copy(), low.copy(), nice.copy()
        top[left], low[left], nice[left] = np.maximum(top[left], top[right]), low_, nice_
        keep = np.ones(len(run), dtype=bool)
        keep[right] = False
        run, place, top, low, nice = run[keep], place[keep], top[keep], low[keep], nice[keep]
    return place, top, low, nice


def _merge_batches(keys: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of the groups of a stream sorted by group and order; only the group at a batch's end is held."""
    open_ = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if open_ is not None:  # Spark's columns may be declared free of nulls, those of a summary are not
            table = pa.concat_tables([open_, table.cast(open_.schema)])
        if not table.num_rows:
            continue
        table = table.combine_chunks()
        n = table.num_rows
        change = np.zeros(n, dtype=bool)
        for k in keys:
            codes = table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            change[1:] |= codes[1:] != codes[:-1]
        column = lambda c: table[c].to_numpy(zero_copy_only=False)
        has = ~table["nice_id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        score = np.concatenate([column("low_score"), table["nice_score"].fill_null(0.0).to_numpy()])
        must = np.concatenate([column("low_must"), table["nice_must"].fill_null(False).to_numpy(zero_copy_only=False)])
        place, top, low, nice = merged(np.cumsum(change), column("top"), np.arange(n), np.where(has, np.arange(n) + n, -1),
                                       score, must.astype(bool))
        ids = pa.concat_arrays([table["low_id"].combine_chunks(), table["nice_id"].combine_chunks()])
        none = nice < 0
        some = np.maximum(nice, 0)
        columns = {k: table[k].take(pa.array(place)) for k in [*keys, "first_ord"]} | {
            "top": pa.array(top), "low_score": pa.array(score[low]), "low_must": pa.array(must[low].astype(bool)),
            "low_id": ids.take(pa.array(low)), "nice_score": pa.array(score[some], mask=none),
            "nice_must": pa.array(must[some].astype(bool), mask=none),
            "nice_id": ids.take(pa.array(nice, mask=none))}
        done = pa.table(columns).select(table.column_names)
        open_ = done.slice(done.num_rows - 1)
        yield from done.slice(0, done.num_rows - 1).to_batches()
    if open_ is not None:
        yield from open_.to_batches()


def _merged_frame(rows: DataFrame, by: list[str], spread: list[str], order: str) -> DataFrame:
    """Summaries of ``rows`` for each group ``by``, rows of a group being neighbours in ``order``."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    held = rows.repartition(*spread).sortWithinPartitions(*by, order).select(*by, *[x.split()[0] for x in _STATE.split(", ")])
    return held.mapInArrow(lambda batches: _merge_batches(by, batches), f"{kinds}, {_STATE}")


def ordered_fold(rows: DataFrame, keys: list[str], order: str, score: str, must, name: str, chunk: int = CHUNK) -> DataFrame:
    """(*keys, first_ord, score, must, id): the fold's winner of each group, and the least ``order`` of its rows.

    ``must`` is a boolean column expression, ``name`` the column that becomes ``id``; ``order`` is unique in a group."""
    single = rows.select(
        *keys, F.col(order).cast("long").alias("first_ord"), F.col(score).cast("double").alias("top"),
        F.floor(F.col(order) / F.lit(chunk)).alias("chunk_"), must.alias("must_"), F.col(name).cast("string").alias("name_"))
    one = lambda c: F.when(F.col("must_"), F.col(c))
    items = single.select(*keys, "chunk_", "first_ord", "top", F.col("top").alias("low_score"), F.col("must_").alias("low_must"),
                          F.col("name_").alias("low_id"), one("top").alias("nice_score"), one("must_").alias("nice_must"),
                          one("name_").alias("nice_id"))
    chunks = _merged_frame(items, [*keys, "chunk_"], [*keys, "chunk_"], "first_ord")
    whole = _merged_frame(chunks, keys, keys, "chunk_")
    return whole.select(*keys, "first_ord", F.col("low_score").alias("score"), F.col("low_must").alias("must"),
                        F.col("low_id").alias("id"))
