"""Toxicity score: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes (2**FEATURE_BITS slots) of its words, word pairs and pairs with one word
between. Training runs over a bounded, hash-ordered sample of the labelled rows; per-coordinate rates adapt to each
feature and the L1 term keeps the weight of rare ones at exactly zero, so the model is a short list of (slot, weight),
at most 2**FEATURE_BITS, that is broadcast to score whole texts.

Defined results: a null or empty text scores by the bias alone; repeated rows score alike; a doc_id labelled more than
once counts with its largest label; without labelled rows every score is 0.5 minus a step (predicted 0); labels of
rows without a document, and without a doc_id, are ignored. A very long text is scored whole; it is learned from whole,
or not at all if it does not fit into the sample's bound. A score of 0.5 counts as toxic. Extra columns, whatever their
names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.llm.common import WordScanner, first_by_hash, slices, text_buffers, whole_rows_within, written

FEATURE_BITS = 20
#: Bounds of the training sample: documents, and features of all of them together; its documents count whole.
SAMPLE_ROWS, SAMPLE_FEATURES = 20_000, 1 << 26
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 8.0, 0.1, 4

_PAIR, _SKIP = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _slots(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of each feature occurrence."""
    shift = np.uint64(64 - FEATURE_BITS)
    found = [(rows, words >> shift)]
    for gap, mix in ((1, _PAIR), (2, _SKIP)):
        if len(words) > gap:
            same = rows[:-gap] == rows[gap:]
            h = (words[:-gap] ^ mix) * _PAIR + words[gap:]
            h = (h ^ (h >> np.uint64(32))) * _SKIP
            found.append((rows[:-gap][same], h[same] >> shift))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, label, text) -> (ord, label, features): distinct slots of each text."""
    scanner = WordScanner()
    for batch in batches:
        offsets, data = text_buffers(batch.column(2))
        lists: list[np.ndarray] = []
        for i, j in slices(offsets):
            _, _, rows, h = scanner.scan(offsets, data, i, j)
            rows, slot = _slots(h, rows)
            key = np.unique(rows * (1 << FEATURE_BITS) + slot)
            cuts = np.searchsorted(key, np.arange(1, j - i) << FEATURE_BITS)
            for x in np.split(key & ((1 << FEATURE_BITS) - 1), cuts):
                lists.append(x.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["ord", "label", "features"])


class Ftrl:
    """FTRL-proximal for examples whose features are present or absent; slot 2**FEATURE_BITS is the bias."""

    def __init__(self, slots: int) -> None:
        self.z, self.n = np.zeros(slots + 1), np.zeros(slots + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task over the bounded sample, in the order of its rows; yields the non-zero weights."""
    bias = 1 << FEATURE_BITS
    model, held, labels = Ftrl(bias), [], []
    often, room = np.zeros(bias, dtype=np.int32), SAMPLE_FEATURES
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum([len(x) for x in batch.column(2)], dtype=np.int64)
        fit = int(np.searchsorted(ends, room, side="right"))
        if fit == 0 and not labels:
            fit = 1  # the first document counts whatever its length
        room = room - int(ends[-1]) if fit == batch.num_rows else -1  # none follows one that did not fit
        batch = batch.slice(0, fit)
        labels += batch.column(1).to_pylist()
        held.append(batch.column(2))
        often += np.bincount(batch.column(2).flatten().to_numpy(), minlength=bias).astype(np.int32)
    # a feature moves its z by less than one an example: too rare ones can never pass L1 and are left out
    useful = np.append(often * EPOCHS > L1, True)
    examples = []
    while held:
        lists = held.pop(0)
        for r in range(len(lists)):
            x = lists[r].values.to_numpy()
            examples.append(np.append(x[useful[x]], np.int32(bias)))
    examples = list(zip(examples, labels))
    for _ in range(EPOCHS):
        for at, label in examples:
            model.learn(at, label)
    w = model.weights()
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], ["slot", "weight"])


@dataclass(frozen=True)
class Model:
    slots: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros((1 << FEATURE_BITS) + 1)
        out[self.slots] = self.weights
        return out


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model from at most ``sample_rows`` of the (doc_id, label) rows, the first by a hash of doc_id."""
    known = (labels.where("label is not null and doc_id is not null")
             .groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).withColumn("ord", F.xxhash64("doc_id")))
    sample = first_by_hash(known, "ord", sample_rows).select(F.col("doc_id").alias("l_id"), "label", "ord")
    rows = (documents.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"))
            .select("ord", "label", "text").mapInArrow(_features, "ord long, label int, features array<int>"))
    rows = (whole_rows_within(written(rows, "toxicity-sample"), F.size("features"), SAMPLE_FEATURES)
            .select("ord", "label", "features").repartition(1).sortWithinPartitions("ord", "features")
            .mapInArrow(_fit, "slot int, weight double").collect())  # at most 2**FEATURE_BITS + 1 rows
    return Model(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64))


def text_scores(model: Model, offsets: np.ndarray, data: np.ndarray, scanner: WordScanner,
                dense: np.ndarray) -> np.ndarray:
    total = np.full(len(offsets) - 1, dense[-1])
    for i, j in slices(offsets):
        _, _, rows, h = scanner.scan(offsets, data, i, j)
        rows, slot = _slots(h, rows)
        used = dense[slot] != 0
        key = np.unique(rows[used] * (1 << FEATURE_BITS) + slot[used])
        total[i:j] += np.bincount(key >> FEATURE_BITS, dense[key & ((1 << FEATURE_BITS) - 1)], minlength=j - i)
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, row_key, score and predicted."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, m = WordScanner(), shared.value
        dense = m.dense()
        for batch in batches:
            p = text_scores(m, *text_buffers(batch.column(2)), scanner, dense)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)],
                                             ["doc_id", "row_key", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return (documents.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
            .mapInArrow(run, f"doc_id {kind}, row_key long, score double")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def held_out(modulus: int, rest: int):
    """Whether crc32 of the doc_id as text leaves ``rest``; a null doc_id is not held out."""
    r = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == rest
    return F.coalesce(r, F.lit(False))


def trained(documents: DataFrame, labels: DataFrame) -> Model:
    """Model from the rows of ``labels`` (doc_id, toxic) outside the held-out fifth."""
    return fit(documents, labels.where(~held_out(5, 0)).select("doc_id", F.col("toxic").alias("label")))
