"""Document quality by a linear-chain conditional random field over lines.

Each line has a label, good or bad. Its features are shares of its characters and words (see FEATURES), together with
those of the lines before and after; pairs of neighbouring labels have weights of their own. Trained on a bounded
sample of whole documents whose label all their lines bear, by gradient steps on the conditional likelihood.
Forward-backward gives each line's marginal probability of being good and so its label (``line_labels``); their mean
weighted by line length, put through a two-parameter logistic curve fitted on the same sample (so that 0.5 parts the
labels), is the document's score. Lines of many documents are swept together, position by position, over whole texts.

Defined results: a null or empty text is one empty line; repeated rows score alike, rows that share a doc_id each by
their own text; a doc_id labelled more than once counts with its largest label, a null one is not learned from; without
labelled rows all weights are zero and every score is 0.5. A very long text is scored whole; it is learned from whole,
or not at all if it has more lines than the sample's bound. A score of 0.5 counts as good. Extra columns, whatever their
names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.llm.common import (WordScanner, first_by_hash, row_key, slices, text_buffers, whole_rows_within,
                                   written)
from skillweave.llm.toxicity import held_out

#: Bounds of the training sample of whole documents: labels, and lines of all documents together.
SAMPLE_ROWS, SAMPLE_LINES = 4_000, 1 << 18
STEPS, RATE, DECAY = 120, 0.15, 1e-3
FEATURES = ["one", "log bytes", "log words", "upper case", "digits", "symbols", "cries", "bars", "points", "space",
            "repeated words", "word length", "line again", "empty"]
_N = len(FEATURES)


def _classes() -> np.ndarray:
    """Byte classes: 0 other, 1 lower case or non-ASCII, 2 upper case, 3 digit, 4 symbol, 5 cry, 6 bar, 7 point, 8 space."""
    c = np.zeros(256, dtype=np.int64)
    c[0x61:0x7B] = c[0x80:] = 1
    c[0x41:0x5B] = 2
    c[0x30:0x3A] = 3
    for chars, k in (("#$%&*+/<=>@[\\]^_`{}~", 4), ("!?", 5), ("|", 6), (".,;:'\"()-", 7), (" \t\r\v\f", 8)):
        c[list(chars.encode())] = k
    return c


_CLASS = _classes()


def line_features(offsets: np.ndarray, data: np.ndarray, i: int, j: int, scanner: WordScanner):
    """(first line of each row, with one more; bytes of each line; own features) of rows i..j."""
    lo, hi = int(offsets[i]), int(offsets[j])
    chunk = data[lo:hi]
    begins = np.asarray(offsets[i:j]) - lo
    breaks = np.flatnonzero(chunk == 0x0A)
    # a line begins at each row's start and after each break; a row's first line sorts before a break's at one place
    starts = np.concatenate([begins, breaks + 1])
    rows = np.concatenate([np.arange(j - i), np.searchsorted(begins, breaks, side="right") - 1])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    first = np.searchsorted(rows, np.arange(j - i + 1))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = first[1:] - 1
    ends[last] = np.asarray(offsets[i + 1:j + 1]) - lo
    size = ends - starts
    # a byte's line by its position: lines that end before the next begins
    line_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, hi - lo))) if len(chunk) else starts[:0]
    share = np.bincount(line_of * 9 + _CLASS[chunk], minlength=9 * len(starts)).reshape(-1, 9).astype(np.float64)
    w_start, w_end, _, h = scanner.scan(offsets, data, i, j)
    w_line = line_of[w_start - lo] if len(h) else np.zeros(0, dtype=np.int64)
    words = np.bincount(w_line, minlength=len(starts)).astype(np.float64)
    again = np.zeros(len(starts))
    if len(h) > 1:
        twin = (h[1:] == h[:-1]) & (w_line[1:] == w_line[:-1])
        again = np.bincount(w_line[1:][twin], minlength=len(starts)).astype(np.float64)
    letters = np.bincount(w_line, (w_end - w_start), minlength=len(starts)) if len(h) else np.zeros(len(starts))
    mark = np.bincount(w_line, (h >> np.uint64(20)).astype(np.float64) % 1e6, minlength=len(starts)) + size
    _, back, count = np.unique(np.stack([rows, mark.astype(np.int64)]), axis=1, return_inverse=True, return_counts=True)
    twice = (count[back.ravel()] > 1) & (size > 0)
    of = lambda k: np.sqrt(share[:, k] / np.maximum(size, 1))
    x = np.stack([np.ones(len(starts)), np.log1p(size) / 8, np.log1p(words) / 6,
                  np.sqrt(share[:, 2] / np.maximum(share[:, 1] + share[:, 2], 1)), of(3), of(4), of(5), of(6), of(7), of(8),
                  np.sqrt(again / np.maximum(words, 1)), letters / np.maximum(words, 1) / 10, twice, size == 0], axis=1)
    return first, size, x


def with_neighbours(first: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Features of each line with those of the line before and after it in its row, zero where there is none."""
    out = np.zeros((len(x), 3 * _N))
    out[:, :_N] = x
    out[1:, _N:2 * _N] = x[:-1]
    out[:-1, 2 * _N:] = x[1:]
    out[first[:-1], _N:2 * _N] = 0
    out[first[1:] - 1, 2 * _N:] = 0
    return out


def marginals(first: np.ndarray, unary: np.ndarray, change: np.ndarray):
    """Forward-backward over all chains at once: (probability of good per line, log-likelihood base per chain,
    expected equal pairs bad and good). ``unary`` is the score of good against bad, ``change`` the scores of two bad
    and of two good neighbours against a change."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    start, length = first[:-1][order], length[order]
    n = len(unary)
    stay = np.exp(change)  # bad-bad, good-good
    e = np.exp(np.clip(unary, -30, 30))
    good = e / (1 + e)  # normalised weight of good at each line
    fwd, bwd = np.empty(n), np.empty(n)  # share of good in the messages
    fwd[start] = good[start]
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right") if len(length) else []
    for t in range(1, length[0] if len(length) else 0):
        at = start[:active[t]] + t
        p = fwd[at - 1]
        to_good, to_bad = p * stay[1] + (1 - p), p + (1 - p) * stay[0]
        g, b = to_good * good[at], to_bad * (1 - good[at])
        fwd[at] = g / (g + b)
    bwd[start + length - 1] = 0.5
    for t in range((length[0] if len(length) else 0) - 2, -1, -1):
        at = start[:active[t + 1]] + t
        g, b = bwd[at + 1] * good[at + 1], (1 - bwd[at + 1]) * (1 - good[at + 1])
        to_good, to_bad = g * stay[1] + b, g + b * stay[0]
        bwd[at] = to_good / (to_good + to_bad)
    up, down = fwd * bwd, (1 - fwd) * (1 - bwd)
    p = up / (up + down)
    inner = np.ones(n, dtype=bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    f, g = fwd[at - 1], bwd[at] * good[at]
    b = (1 - bwd[at]) * (1 - good[at])
    gg, bb, rest = f * stay[1] * g, (1 - f) * stay[0] * b, f * b + (1 - f) * g
    total = gg + bb + rest
    return p, bb / total, gg / total


class LineField:
    """Weights of the field (unary features, then the two pair scores) and slope and offset of the score's curve."""

    def __init__(self, weights: np.ndarray | None = None, curve: np.ndarray | None = None) -> None:
        self.weights = np.zeros(3 * _N + 2) if weights is None else weights
        self.curve = np.array([1.0, 0.0]) if curve is None else curve

    def fit(self, first: np.ndarray, x: np.ndarray, label: np.ndarray) -> LineField:
        """Adam steps on the mean log-likelihood of documents; ``label`` per document."""
        if not len(label):
            return self
        y = np.repeat(label, np.diff(first)).astype(np.float64)
        doc_weight = 1 / np.repeat(np.diff(first), np.diff(first))
        inner = np.ones(len(x), dtype=bool)
        inner[first[:-1]] = False
        yi, wi = y[inner], doc_weight[inner]
        m, v = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for step in range(1, STEPS + 1):
            p, bb, gg = marginals(first, x @ self.weights[:-2], self.weights[-2:])
            grad = np.concatenate([x.T @ ((y - p) * doc_weight),
                                   [((1 - yi - bb) * wi).sum(), ((yi - gg) * wi).sum()]]) / len(label)
            grad -= DECAY * self.weights
            m = 0.9 * m + 0.1 * grad
            v = 0.99 * v + 0.01 * grad * grad
            self.weights = self.weights + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        size = np.expm1(8 * x[:, FEATURES.index("log bytes")])
        self._fit_curve(self._means(first, size, x), label)
        return self

    def _means(self, first: np.ndarray, size: np.ndarray, x: np.ndarray) -> np.ndarray:
        p, _, _ = marginals(first, x @ self.weights[:-2], self.weights[-2:])
        return _weighted(first, size, p)

    def _fit_curve(self, means: np.ndarray, label: np.ndarray) -> None:
        """Newton steps of a logistic regression on the means' log-odds, with a small ridge around slope 1."""
        z = np.stack([_log_odds(means), np.ones(len(means))], axis=1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.curve, -30, 30)))
            grad = z.T @ (label - p) - (self.curve - [1.0, 0.0])
            hess = (z * (p * (1 - p))[:, None]).T @ z + np.eye(2)
            self.curve = self.curve + np.clip(np.linalg.solve(hess, grad), -1, 1)

    def lines(self, offsets: np.ndarray, data: np.ndarray, scanner: WordScanner) -> Iterator[tuple]:
        """(first text, one after the last, first line of each text, bytes and marginal of each line), slice by slice."""
        for i, j in slices(offsets):
            first, size, x = line_features(offsets, data, i, j, scanner)
            p, _, _ = marginals(first, with_neighbours(first, x) @ self.weights[:-2], self.weights[-2:])
            yield i, j, first, size, p

    def score(self, offsets: np.ndarray, data: np.ndarray, scanner: WordScanner) -> np.ndarray:
        """Length-weighted mean marginal of the lines of each text, put through the curve."""
        out = np.empty(len(offsets) - 1)
        for i, j, first, size, p in self.lines(offsets, data, scanner):
            means = _weighted(first, size, p)
            out[i:j] = 1 / (1 + np.exp(-np.clip(self.curve[0] * _log_odds(means) + self.curve[1], -500, 500)))
        return out


def _weighted(first: np.ndarray, size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Mean of the lines' marginals by document, weighted by length."""
    weight = size + 1.0
    return np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def _sample_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, label, text) -> (ord, label, lines): features of all lines, flat."""
    scanner = WordScanner()
    for batch in batches:
        offsets, data = text_buffers(batch.column(2))
        flat = []
        for i, j in slices(offsets):
            first, _, x = line_features(offsets, data, i, j, scanner)
            x = with_neighbours(first, x).astype(np.float32)
            flat += [x[first[r]:first[r + 1]].ravel() for r in range(j - i)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat, pa.list_(pa.float32()))],
                                         ["ord", "label", "lines"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task over the bounded sample; yields the weights."""
    xs, labels = [], []
    for batch in batches:
        labels += batch.column(1).to_pylist()
        xs += [batch.column(2)[r].values.to_numpy().reshape(-1, 3 * _N) for r in range(batch.num_rows)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int64)
    x = np.concatenate(xs).astype(np.float64) if xs else np.zeros((0, 3 * _N))
    field = LineField().fit(first, x, np.array(labels, dtype=np.float64))
    values = np.concatenate([field.weights, field.curve])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["at", "weight"])


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LineField:
    """Field from at most ``sample_rows`` of the (doc_id, label) rows, the first by a hash of doc_id, whose documents
    have at most SAMPLE_LINES lines together."""
    known = (labels.where("label is not null and doc_id is not null")
             .groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).withColumn("ord", F.xxhash64("doc_id")))
    sample = first_by_hash(known, "ord", sample_rows).select(F.col("doc_id").alias("l_id"), "label", "ord")
    texts = written(documents.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"))
                    .select("ord", "label", "text"), "quality-sample")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    rows = (whole_rows_within(texts, F.coalesce(n_lines, F.lit(1)), SAMPLE_LINES).select("ord", "label", "text")
            .mapInArrow(_sample_lines, "ord long, label int, lines array<float>").repartition(1).sortWithinPartitions("ord", "lines")
            .mapInArrow(_fit, "at long, weight double").collect())  # one row per weight
    values = np.concatenate([LineField().weights, LineField().curve])
    for at, w in rows:
        values[at] = w
    return LineField(values[:-2], values[-2:])


def score(documents: DataFrame, field: LineField) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, row_key, score and predicted."""
    shared = documents.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner()
        for batch in batches:
            p = shared.value.score(*text_buffers(batch.column(2)), scanner)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)],
                                             ["doc_id", "row_key", "score"])
    kind = documents.schema["doc_id"].dataType.simpleString()
    return (documents.select("doc_id", row_key(), "text").mapInArrow(run, f"doc_id {kind}, row_key long, score double")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def line_labels(documents: DataFrame, field: LineField) -> DataFrame:
    """Per line of each row of ``documents``: doc_id, row_key, line (from 0), n_bytes, marginal (of being good) and label
    (1 good, 0 bad). ``score`` is the mean of these marginals weighted by n_bytes + 1, put through the field's curve."""
    shared = documents.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner()
        for batch in batches:
            for i, j, first, size, p in shared.value.lines(*text_buffers(batch.column(2)), scanner):
                row = np.repeat(np.arange(i, j), np.diff(first))
                at = np.arange(len(p)) - np.repeat(first[:-1], np.diff(first))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(at),
                     pa.array(size.astype(np.int64)), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    ["doc_id", "row_key", "line", "n_bytes", "marginal", "label"])
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", row_key(), "text").mapInArrow(
        run, f"doc_id {kind}, row_key long, line long, n_bytes long, marginal double, label int")


def trained(documents: DataFrame, labels: DataFrame) -> LineField:
    """Field from the rows of ``labels`` (doc_id, quality) outside the held-out third."""
    return fit(documents, labels.where(~held_out(3, 1)).select("doc_id", F.col("quality").alias("label")))
