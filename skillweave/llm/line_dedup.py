"""Reversible line deduplication: sharded cuckoo filters backed by exact reference counts.

State: ``postings`` (key, doc_id, step), one row per document and line key, and one with step -1 for each that is taken
back, from which the exact reference counts (key, n_docs, max_doc) are aggregated; and the cuckoo filters, one per shard,
of the keys that reached ``min_docs``. A document is added or deleted by appending its postings; only the counts of its
keys are made anew, as a layer over the counts before, and keys that cross ``min_docs`` are inserted into or deleted from
their shard's filter. Cleaning probes the broadcast filters in the scan; only positive lines are joined with the exact
counts, and only texts that may lose a line move.

There are as many shards as the keys need (SHARD_KEYS each) up to SHARDS, whose filters take 128 MB; when keys outgrow
them, the filters are rebuilt with more shards. Beyond that a shard that cannot take a key is marked as full; then each
of its lines is positive and the exact join alone decides. A full shard whose keys fit again is rebuilt from the counts.

Defined results: a null or empty text is one empty line; each row counts as a document of its own, also where a
doc_id repeats, and all rows of the largest doc_id keep a line; a null doc_id is below any other, and if a line lies
in no document with a doc_id it stays everywhere. Texts of any length are taken whole. Taking back a document that was
not added changes nothing. Extra columns pass through, also where they are called as a column made here; ``clean``
calls its own n_lines and n_dropped, and leaves those of the input out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.llm.common import perhaps_in, row_key, same_row, split_rows, written

MIN_DOCS, MIN_CHARS = 3, 20
#: Most shards, and the size of a filter; a shard is to hold SHARD_KEYS of its BUCKETS * SLOTS places.
SHARDS, BUCKETS, SLOTS = 512, 1 << 15, 4
SHARD_KEYS = 90_000
KICKS = 200
#: Layers of changed counts, and of postings, that are kept apart.
LAYERS = 8
#: Parts into which the lines of a hot key are dealt for the join with its count.
SALTS = 16
_STRIP = b" \t\n\r\x0b\x0c"


# ---- cuckoo filter ---------------------------------------------------------------------------------------------

def _fold(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


class CuckooFilter:
    """Partial-key cuckoo filter of 16-bit fingerprints over 64-bit hashes; ``full`` once an insertion fails."""

    def __init__(self, cells: np.ndarray | None = None, full: bool = False) -> None:
        self.cells = np.zeros((BUCKETS, SLOTS), dtype=np.uint16) if cells is None else cells
        self.full = full

    @staticmethod
    def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, bucket, other bucket) of each hash."""
        h = _fold(h)
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
        return mark, first, CuckooFilter.other(first, mark)

    @staticmethod
    def other(bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (_fold(np.asarray(mark)) & np.uint64(BUCKETS - 1)).astype(np.int64)

    def insert(self, h: np.ndarray) -> None:
        mark, first, second = self.places(h)
        random = np.random.default_rng(1)
        for m, a, b in zip(mark, first, second):
            for at in (a, b):
                free = np.flatnonzero(self.cells[at] == 0)
                if len(free):
                    self.cells[at, free[0]] = m
                    break
            else:
                at = a
                for _ in range(KICKS):
                    slot = random.integers(SLOTS)
                    m, self.cells[at, slot] = self.cells[at, slot], m
                    at = int(self.other(np.array([at]), np.array([m], dtype=np.uint16))[0])
                    free = np.flatnonzero(self.cells[at] == 0)
                    if len(free):
                        self.cells[at, free[0]] = m
                        break
                else:
                    self.full = True
                    return

    def delete(self, h: np.ndarray) -> None:
        """Hashes that were inserted."""
        for m, a, b in zip(*self.places(h)):
            for at in (a, b):
                held = np.flatnonzero(self.cells[at] == m)
                if len(held):
                    self.cells[at, held[0]] = 0
                    break

    def holds(self, h: np.ndarray) -> np.ndarray:
        if self.full:
            return np.ones(len(h), dtype=bool)
        mark, first, second = self.places(h)
        return ((self.cells[first] == mark[:, None]) | (self.cells[second] == mark[:, None])).any(axis=1)


def shard_count(n_keys: int) -> int:
    """Shards for so many keys, a power of two."""
    return min(SHARDS, 1 << (max(1, -(-n_keys // SHARD_KEYS)) - 1).bit_length())


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h.astype(np.uint64) >> np.uint64(55)) & np.uint64(shards - 1)).astype(np.int64)


def _hash(keys) -> np.ndarray:
    """First eight bytes of each key, as the filters take them."""
    return np.frombuffer(b"".join(bytes(k)[:8] for k in keys), dtype=">u8").astype(np.uint64)


# ---- line keys -------------------------------------------------------------------------------------------------

def line_keys(text: str | None) -> list[bytes | None]:
    """Per line of a text its 128-bit key, or None if the stripped line is under MIN_CHARS code points."""
    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        line = line.strip(_STRIP).lower()
        long = len(line) >= 4 * MIN_CHARS or (len(line) >= MIN_CHARS
                                              and sum((c & 0xC0) != 0x80 for c in line) >= MIN_CHARS)
        out.append(hashlib.md5(line, usedforsecurity=False).digest() if long else None)
    return out


def postings(documents: DataFrame) -> DataFrame:
    """(key, doc_id): each line key of each row of ``documents`` (doc_id, text) once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys = [], []
            for row, text in enumerate(batch.column(1)):
                own = {k for k in line_keys(text.as_py()) if k}
                keys.extend(own)
                at.extend([row] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0).take(pa.array(at, pa.int64()))],
                                             ["key", "doc_id"])
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"key binary, doc_id {kind}")


def reference_counts(lines: DataFrame) -> DataFrame:
    """Exact (key, n_docs, max_doc) of postings; partial aggregation bounds what a hot key shuffles."""
    return lines.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))


# ---- filters ---------------------------------------------------------------------------------------------------

_FILTERS = "shard int, cells binary, full boolean"


def _with_shard(keys: DataFrame, shards: int) -> DataFrame:
    first = F.conv(F.hex(F.substring("key", 1, 2)), 16, 10).cast("int")
    return keys.withColumn("shard", F.shiftright(first, 7).bitwiseAND(F.lit(shards - 1)).cast("int"))


def build_filters(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """A cuckoo filter for each of the shards that the keys found in at least ``min_docs`` documents need."""
    keys = counts.where(F.col("n_docs") >= min_docs).select("key", F.lit(1).alias("step"))
    shards = shard_count(keys.count())
    return change_filters(_empty_filters(counts, range(shards)), keys, shards)


def _empty_filters(counts: DataFrame, shards) -> DataFrame:
    return counts.sparkSession.createDataFrame([(s, None, False) for s in shards], _FILTERS)


def change_filters(filters: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
    """Filters after inserting (step 1) and deleting (step -1) the keys of ``changes`` (key, step). A shard stops at its
    capacity, so its task holds no more than the filters of its shards and one batch of keys."""
    rows = _with_shard(changes, shards).select("shard", "key", "step", F.lit(None).cast("binary").alias("cells"),
                                               F.lit(False).alias("full"))
    rows = rows.unionByName(filters.select("shard", F.lit(None).cast("binary").alias("key"), F.lit(0).alias("step"),
                                           "cells", "full"))
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "step", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, CuckooFilter] = {}
        late: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            f = batch.to_pandas()
            for shard, part in f.groupby("shard"):
                for _, r in part[part["step"] == 0].iterrows():
                    cells = None if r["cells"] is None else np.frombuffer(bytes(r["cells"]), np.uint16).reshape(BUCKETS, SLOTS).copy()
                    held[shard] = CuckooFilter(cells, bool(r["full"]))
                gone = part[part["step"] < 0]
                if len(gone):
                    late.setdefault(shard, []).append(_hash(gone["key"]))
                new = part[part["step"] > 0]
                if len(new) and shard in held and not held[shard].full:
                    held[shard].insert(_hash(new["key"]))
        for shard, hashes in late.items():
            if shard in held and not held[shard].full:
                held[shard].delete(np.concatenate(hashes))
        out = pd.DataFrame({"shard": list(held), "cells": [x.cells.tobytes() for x in held.values()],
                            "full": [x.full for x in held.values()]})
        yield pa.RecordBatch.from_pandas(out, schema=pa.schema([("shard", pa.int32()), ("cells", pa.binary()),
                                                                ("full", pa.bool_())]), preserve_index=False)
    return rows.mapInArrow(run, _FILTERS)


# ---- cleaning --------------------------------------------------------------------------------------------------

def clean(documents: DataFrame, counts: DataFrame, filters: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``documents`` (doc_id, text and any other columns) with text replaced by the kept lines, plus n_lines and
    n_dropped."""
    spark = documents.sparkSession
    parts = filters.collect()  # at most SHARDS filters of fixed size, one for each shard
    shared = spark.sparkContext.broadcast({r["shard"]: (None if r["full"] else bytes(r["cells"])) for r in parts})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: CuckooFilter(None if c is None else np.frombuffer(c, dtype=np.uint16).reshape(BUCKETS, SLOTS), c is None)
                for s, c in shared.value.items()}
        for batch in batches:
            keys, at = [], []
            for row, text in enumerate(batch.column(2)):
                own = {k for k in line_keys(text.as_py()) if k}
                keys.extend(own)
                at.extend([row] * len(own))
            h, at = _hash(keys), np.array(at, dtype=np.int64)
            positive = np.zeros(len(h), dtype=bool)
            shard = _shard(h, max(1, len(held)))
            for s, own in held.items():
                here = shard == s
                positive[here] = own.holds(h[here])
            take = pa.array(at[positive])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take),
                 pa.array([keys[i] for i in np.flatnonzero(positive)], pa.binary())], ["doc_id", "row_key", "key"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    positive = documents.select("doc_id", row_key(), "text").mapInArrow(probe, f"doc_id {kind}, row_key long, key binary")
    positive = positive.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    exact = (counts.where(F.col("n_docs") >= min_docs).select("key", "max_doc")
             .withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)]))))
    dropped = written(
        positive.join(exact, ["key", "salt"])
        .where(F.col("doc_id").isNull() & F.col("max_doc").isNotNull() | (F.col("doc_id") < F.col("max_doc")))
        .groupBy("doc_id", "row_key").agg(F.collect_set("key").alias("drop_keys")), "line-drops")
    renamed = dropped.select(F.col("doc_id").alias("__d_id"), F.col("row_key").alias("__d_key"),
                             F.col("drop_keys").alias("__drops"))
    whole, perhaps = split_rows(documents, dropped)
    touched = perhaps.join(renamed, same_row(perhaps, "__d_id", "__d_key"), "left").drop("__d_id", "__d_key")
    both = whole.withColumn("__drops", F.lit(None).cast("array<binary>")).unionByName(touched)
    lines, drops = F.split(F.coalesce("text", F.lit("")), "\n"), F.col("__drops")
    kept = F.when(drops.isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(drops, _key_of(x))))
    both = both.withColumn("__kept", kept)
    own = [c for c in documents.columns if c not in ("text", "n_lines", "n_dropped")]
    return both.select(*[F.col(f"`{c}`") for c in own], F.array_join("__kept", "\n").alias("text"),
                       F.size(lines).cast("long").alias("n_lines"),
                       (F.size(lines) - F.size("__kept")).cast("long").alias("n_dropped"))


def _key_of(line):
    """The key of a line as an expression, equal to line_keys(); short lines give a key that no count has."""
    bare = F.translate(F.btrim(line, F.lit(_STRIP.decode())), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.unhex(F.md5(bare.cast("binary")))


class LineDedupState:
    """Postings, counts and filters as written tables; ``add`` and ``delete`` give the next state."""

    def __init__(self, lines: list[DataFrame], base: DataFrame, layers: list[DataFrame], filters: DataFrame, min_docs: int) -> None:
        #: postings (key, doc_id, step) of the documents at the start, and of each change
        self.lines, self.base, self.layers, self.filters, self.min_docs = lines, base, layers, filters, min_docs

    @classmethod
    def of(cls, documents: DataFrame, min_docs: int = MIN_DOCS) -> LineDedupState:
        lines = postings(documents)
        base = written(reference_counts(lines), "line-counts")
        return cls([lines.withColumn("step", F.lit(1))], base, [], written(build_filters(base, min_docs), "line-filters"), min_docs)

    @property
    def counts(self) -> DataFrame:
        """Exact (key, n_docs, max_doc): the base's, but for keys that a later layer has anew."""
        if not self.layers:
            return self.base
        latest = None
        for number, layer in enumerate(self.layers):
            layer = layer.withColumn("layer", F.lit(number))
            latest = layer if latest is None else latest.unionByName(layer)
        latest = latest.groupBy("key").agg(F.max_by(F.struct("n_docs", "max_doc"), "layer").alias("c")).select("key", "c.*")
        return (self.base.join(latest.select("key"), "key", "left_anti")
                .unionByName(latest.where("n_docs > 0")))

    def _next(self, delta: DataFrame) -> LineDedupState:
        """The state after the postings of ``delta``: only its keys' postings are gathered and counted."""
        if len(self.lines) == 1:  # until the first change they need not be kept
            self.lines = [written(self.lines[0], "line-postings")]
        delta = written(delta, "line-postings")
        keys = written(delta.select("key").distinct(), "line-keys")
        before = self.lines[0]
        for more in self.lines[1:]:
            before = before.unionByName(more)
        touched = perhaps_in(before, "key", keys).join(keys, "key", "left_semi").unionByName(delta)
        # row by row: as many as were added and not taken back
        held = touched.groupBy("key", "doc_id").agg(F.sum("step").alias("n")).where("n > 0")
        after = held.groupBy("key").agg(F.sum("n").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        layer = written(keys.join(after, "key", "left").select("key", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "max_doc"),
                        "line-counts")
        old = perhaps_in(self.counts, "key", keys).select(F.col("key").alias("k2"), F.col("n_docs").alias("n2"))
        was, now = F.coalesce("n2", F.lit(0)) >= self.min_docs, F.col("n_docs") >= self.min_docs
        step = F.when(now & ~was, 1).when(was & ~now, -1)
        changes = written(layer.join(old, F.col("key") == F.col("k2"), "left").select("key", step.alias("step"))
                          .where("step is not null"), "line-changes")
        lines, layers, base = [*self.lines, delta], [*self.layers, layer], self.base
        if len(layers) > LAYERS:
            base, layers = written(LineDedupState(lines, base, layers, self.filters, self.min_docs).counts, "line-counts"), []
            whole = before.unionByName(delta).groupBy("key", "doc_id").agg(F.sum("step").cast("int").alias("step")).where("step > 0")
            lines = [written(whole.select("key", "doc_id", F.explode(F.sequence(F.lit(1), "step")).alias("one"))
                             .select("key", "doc_id", F.lit(1).alias("step")), "line-postings")]
        state = LineDedupState(lines, base, layers, self.filters, self.min_docs)
        state.filters = written(state._filters_after(changes), "line-filters")
        return state

    def _filters_after(self, changes: DataFrame) -> DataFrame:
        shards = self.filters.count()
        keys = self.counts.where(F.col("n_docs") >= self.min_docs).select("key", F.lit(1).alias("step"))
        if shard_count(keys.count()) > shards:
            return build_filters(self.counts, self.min_docs)
        changed = written(change_filters(self.filters, changes, shards), "line-filters")
        full = [r["shard"] for r in changed.where("full").select("shard").collect()]  # at most SHARDS numbers
        if not full:
            return changed
        sizes = _with_shard(keys, shards).where(F.col("shard").isin(full)).groupBy("shard").count().collect()
        fits = sorted({*full} - {r["shard"] for r in sizes if r["count"] > SHARD_KEYS})
        mine = _with_shard(keys, shards).where(F.col("shard").isin(fits)).drop("shard")
        anew = change_filters(_empty_filters(self.counts, fits), mine, shards)
        return changed.where(~F.col("shard").isin(fits)).unionByName(anew)

    def add(self, documents: DataFrame) -> LineDedupState:
        return self._next(postings(documents).withColumn("step", F.lit(1)))

    def delete(self, documents: DataFrame) -> LineDedupState:
        """Takes back documents that were added, row by row."""
        return self._next(postings(documents).withColumn("step", F.lit(-1)))

    def clean(self, documents: DataFrame) -> DataFrame:
        return clean(documents, self.counts, self.filters, self.min_docs)


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
