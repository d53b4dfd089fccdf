"""Hard negatives by slot-decomposed selection.

Every anchor has up to ``positives`` nearest rows of its own label. A positive of score s allows as negatives the rows
of other labels with ``low`` * s <= 100 * score <= ``high`` * s, so an anchor asks several overlapping windows. Their
upper limits cut the scores into disjoint slots: slot j holds what is at most the j-th limit and above the next. Rows
are scored in blocks; a block keeps the best k rows of each slot (a combiner), blocks are merged slot by slot, and the
windows are answered together by merging slots from the lowest upward: the k best of window j are the k best of slot j
followed by those of the windows below, cut at the window's lower limit.

Scores are integer inner products of floor(``SCALE`` * x). Anchors meet all rows in blocks of fixed size by a cogroup
on block numbers (dealt by hash, so a hot label spreads), vectors travel as bytes, and a block hands on at most k rows
for each slot of an anchor. Nothing passes the driver but two counts and the vectors' length.

Defined results: rows with a null vec_id, label or vector, a null or non-finite component, or another length than the
most frequent one (the larger of equals) take no part; a zero vector does. Anchors that are equal rows count once; other
rows with an anchor's vec_id are its own and never its partners; repeated rows are partners each. Ties go by smaller
vec_id. An anchor without a positive, and a window without a row, give nothing. Scores beyond +-2**62 saturate there. Extra
columns, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweave.llm.common import written

SCALE = 256
K, POSITIVES = 10, 5
LOW, HIGH = 30, 90
ANCHOR_MODULUS = 100
BLOCK_ROWS, BLOCK_ANCHORS = 16_384, 4_096
#: Scores held at a time in a task.
CHUNK_SCORES = 1 << 21
NONE = np.iinfo(np.int64).min
LIMIT = 1 << 62


def _quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q, wide): usable rows, q = the scaled components as 16-bit integers, or as doubles if one is
    larger (``wide``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.floor(SCALE * batch.column(2).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)
            wide = (np.abs(x) >= 1 << 15).any(axis=1)
            q = [a.tobytes() if w else a.astype(np.int16).tobytes() for a, w in zip(x, wide)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(q, pa.binary()), pa.array(wide)],
                                             ["vec_id", "label", "q", "wide"])

    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = (vectors.where("vec_id is not null and label is not null and embedding is not null")
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                    F.col("embedding").cast("array<double>").alias("v")).where(sound & (F.size("v") > 0)))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (top[0]["d"] if top else 0)).mapInArrow(
        run, "vec_id long, label long, q binary, wide boolean")


class Side:
    """Rows of a block: ids, labels, vectors, and which of them hold components beyond 16 bits."""

    def __init__(self, table: pa.Table) -> None:
        self.ids, self.labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        self.wide = table["wide"].to_numpy().astype(bool)
        self.q = np.array([np.frombuffer(x, np.float64 if w else np.int16).astype(np.float64)
                           for x, w in zip(table["q"].to_pylist(), self.wide)])


def _whole(a: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers."""
    return np.array([int(x) for x in a.ravel()], dtype=object).reshape(a.shape)


def scores(a: np.ndarray, a_wide: np.ndarray, b: np.ndarray, b_wide: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers; saturated at +-LIMIT."""
    plain_a, plain_b = np.where(a_wide[:, None], 0, a), np.where(b_wide[:, None], 0, b)
    kind = np.float32 if np.abs(plain_a).max() * np.abs(plain_b).max() * a.shape[1] < 1 << 24 else np.float64
    s = (plain_a.astype(kind) @ plain_b.astype(kind).T).astype(np.int64)
    if a_wide.any():
        s[a_wide] = np.clip(_whole(a[a_wide]) @ _whole(b).T, -LIMIT, LIMIT).astype(np.int64)
    if b_wide.any():
        s[:, b_wide] = np.clip(_whole(a) @ _whole(b[b_wide]).T, -LIMIT, LIMIT).astype(np.int64)
    return s


def best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the up to k highest scores of each row, NONE left out; ties by smaller id."""
    if not s.shape[1]:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kk = min(k, s.shape[1])
    floor = np.maximum(np.partition(s, s.shape[1] - kk, axis=1)[:, s.shape[1] - kk], NONE + 1)
    r, c = np.nonzero(s >= floor[:, None])
    order = np.lexsort((ids[c], -s[r, c], r))
    r, c = r[order], c[order]
    keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(s)))[r] < k
    return r[keep], c[keep]


def _scored(anchors: Side, rows: Side, same: bool):
    """Chunks (anchor numbers, row numbers, scores), of equal or of different labels; an anchor's own rows are NONE."""
    for label in np.unique(anchors.labels):
        own = np.flatnonzero(anchors.labels == label)
        other = np.flatnonzero((rows.labels == label) == same)
        step = max(1, CHUNK_SCORES // max(1, len(other)))
        for at in range(0, len(own) if len(other) else 0, step):
            a = own[at:at + step]
            s = scores(anchors.q[a], anchors.wide[a], rows.q[other], rows.wide[other])
            s[anchors.ids[a][:, None] == rows.ids[other][None, :]] = NONE
            yield a, other, s


def _met(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, kernel, schema: str) -> DataFrame:
    """``kernel(anchor table, row table)`` for every block of anchors with every block of rows."""
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block_of = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    left = rows.select(blocks(n_anchors).alias("ab"), block_of(n_rows, "vec_id", "q").alias("rb"), "vec_id", "label", "q", "wide")
    right = anchors.select(block_of(n_anchors, F.lit(1), "vec_id", "label", "q").alias("ab"), blocks(n_rows).alias("rb"), *[F.col(c).alias(c) for c in anchors.columns])
    kinds = dict(x.split(" ") for x in schema.split(", "))
    empty = pa.table({name: pa.array([], pa.int32() if kind == "int" else pa.int64()) for name, kind in kinds.items()})

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        parts = kernel(asked, block) if block.num_rows and asked.num_rows else []
        return pa.concat_tables(parts) if parts else empty
    return left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInArrow(run, schema)


def positives_of(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, n: int) -> DataFrame:
    """(anchor_id, anchor, slot, positive_id, positive_score): the n nearest of each anchor's label, slots from 0."""
    def kernel(asked, block):
        a, b, out = Side(asked), Side(block), []
        key = asked["anchor"].to_numpy()
        for own, other, s in _scored(a, b, True):
            r, c = best(s, b.ids[other], n)
            out.append(pa.table({"anchor_id": a.ids[own[r]], "anchor": key[own[r]], "positive_id": b.ids[other[c]],
                                 "positive_score": s[r, c]}))
        return out
    found = _met(rows, anchors, n_rows, n_anchors, kernel,
                 "anchor_id long, anchor long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id", "anchor").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < n)


def in_slots(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, k: int) -> DataFrame:
    """(anchor_id, anchor, slot, vec_id, score): the k best rows of another label in each slot of each anchor, of those
    not below ``floor``. Anchors carry ``limits``, the descending upper limits of their windows."""
    def kernel(asked, block):
        a, b, out = Side(asked), Side(block), []
        key, floor = asked["anchor"].to_numpy(), asked["floor"].to_numpy()
        lists = asked["limits"].to_pylist()
        limits = np.full((len(lists), max(map(len, lists)) + 1), NONE, dtype=np.int64)
        for i, x in enumerate(lists):
            limits[i, :len(x)] = x
        for own, other, s in _scored(a, b, False):
            s[s < floor[own][:, None]] = NONE
            for j in range(limits.shape[1] - 1):
                within = (s <= limits[own, j][:, None]) & (s > limits[own, j + 1][:, None])
                live = np.flatnonzero(within.any(axis=1))
                r, c = best(np.where(within[live], s[live], NONE), b.ids[other], k)
                r = live[r]
                out.append(pa.table({"anchor_id": a.ids[own[r]], "anchor": key[own[r]], "slot": np.full(len(r), j, np.int32),
                                     "vec_id": b.ids[other[c]], "score": s[r, c]}))
        return out
    found = _met(rows, anchors, n_rows, n_anchors, kernel, "anchor_id long, anchor long, slot int, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def _in_slot(j: int):
    return lambda x: x["slot"] == j


def windows(slots: DataFrame, positives: DataFrame, n: int, k: int) -> DataFrame:
    """Every positive's window answered from the slots, merged from the lowest slot upward."""
    row = F.struct("slot", (-F.col("score")).alias("down"), F.col("vec_id").alias("id"), "score")
    held = slots.groupBy("anchor_id", "anchor").agg(F.sort_array(F.collect_list(row)).alias("held"))  # at most n * k rows
    held = held.withColumn("from_%d" % n, F.slice("held", 1, 0))
    for j in range(n - 1, -1, -1):
        own = F.filter("held", _in_slot(j))
        held = held.withColumn(f"from_{j}", F.slice(F.concat(own, F.col(f"from_{j + 1}")), 1, k))
    held = held.select("anchor_id", "anchor", F.array(*[f"from_{j}" for j in range(n)]).alias("below"))
    met = positives.join(held, ["anchor_id", "anchor"])
    inside = F.filter(F.get("below", F.col("slot")), lambda x: x["score"] >= F.col("low"))
    return (met.select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "x"))
            .select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"),
                    F.col("x.id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score")))


def _percent(column: str, share: int, up: bool):
    """share * column / 100, rounded up or down, without leaving 64 bits."""
    rest = f"pmod({column}, 100L)"
    return F.expr(f"{share}L * (({column} - {rest}) div 100L) + ({share}L * {rest} + {99 if up else 0}L) div 100L")


def mine(vectors: DataFrame, is_anchor, k: int = K, positives: int = POSITIVES, low: int = LOW,
         high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, embedding,
    label), anchors being the rows where ``is_anchor`` holds. ``low`` and ``high`` are percentages from 0 to 100."""
    rows = written(_quantised(vectors), "hard-negative-rows")
    anchors = rows.where(is_anchor).distinct().withColumn("anchor", F.xxhash64("label", "q"))
    n_rows = -(-rows.count() // BLOCK_ROWS) or 1
    n_anchors = -(-anchors.count() // BLOCK_ANCHORS) or 1
    found = positives_of(rows, anchors, n_rows, n_anchors, positives)
    found = written(found.withColumn("low", _percent("positive_score", low, True))
                    .withColumn("high", _percent("positive_score", high, False)), "hard-negative-positives")
    limits = found.groupBy("anchor_id", "anchor").agg(  # at most ``positives`` of them
        F.sort_array(F.collect_list("high"), asc=False).alias("limits"), F.min("low").alias("floor"))
    asked = anchors.join(limits.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "anchor"])
    return windows(in_slots(rows, asked, n_rows, n_anchors, k), found, positives, k)


def relabelled(vectors: DataFrame) -> DataFrame:
    """The query's rows: where vec_id is divisible by 7 the label moves on by one of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", "embedding", moved.alias("label"))
