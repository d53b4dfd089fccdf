"""The two classifiers against plain restatements: a scalar FTRL, and scores from line marginals."""

import math

import numpy as np
import pyarrow as pa
import pytest

from skillweave.llm import line_quality, toxicity
from skillweave.llm.common import table, whole_rows_within
from tests.llm.conftest import SMALL


def scalar_ftrl(examples, epochs):
    """Weights after learning (slots, label) one example and one coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
    for _ in range(epochs):
        for slots, label in examples:
            w = {i: weight(i) for i in slots}
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w.values()))))) - label
            for i in slots:
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / toxicity.ALPHA * w[i]
                n[i] = before + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_ftrl_equals_the_scalar_one():
    rng = np.random.default_rng(4)
    bias = 1 << toxicity.FEATURE_BITS
    common, bad = rng.integers(0, bias, 30), rng.integers(0, bias, 6)
    examples = []
    for i in range(400):
        label = int(rng.random() < 0.4)
        slots = set(rng.choice(common, 10).tolist()) | (set(rng.choice(bad, 3).tolist()) if label else set())
        examples.append((sorted(slots), label))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(400), pa.int64()), pa.array([y for _, y in examples], pa.int32()),
         pa.array([x for x, _ in examples], pa.list_(pa.int32()))], ["ord", "label", "features"])
    (out,) = toxicity._fit(iter([batch]))
    got = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
    want = scalar_ftrl([([*x, bias], y) for x, y in examples], toxicity.EPOCHS)
    assert got.keys() == want.keys() and len(got) > 5
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)


def test_scores_are_those_of_the_line_marginals(spark):
    docs = table(spark, SMALL, "documents").where("doc_id < 60")
    field = line_quality.trained(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    lines = line_quality.line_labels(docs, field).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    by_doc = {}
    for r in lines:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.label == int(r.marginal >= 0.5)
    for r in line_quality.score(docs, field).collect():
        own = sorted(by_doc[r.doc_id], key=lambda x: x.line)
        parts = texts[r.doc_id].split("\n")
        assert [x.line for x in own] == list(range(len(parts)))
        assert [x.n_bytes for x in own] == [len(x.encode()) for x in parts]
        mean = sum(x.marginal * (x.n_bytes + 1) for x in own) / sum(x.n_bytes + 1 for x in own)
        odds = math.log(max(mean, 1e-9) / max(1 - mean, 1e-9))
        assert r.score == pytest.approx(1 / (1 + math.exp(-(field.curve[0] * odds + field.curve[1]))), abs=1e-6)


def test_line_labels_of_odd_rows(spark, odd_documents):
    field = line_quality.LineField()
    rows = line_quality.line_labels(odd_documents, field).collect()
    want = sum((r.text or "").count("\n") + 1 for r in odd_documents.collect())
    assert len(rows) == want and {round(r.marginal, 9) for r in rows} == {0.5}
    assert line_quality.line_labels(odd_documents.limit(0), field).count() == 0


def test_samples_take_whole_rows_up_to_their_bound(spark):
    rows = spark.createDataFrame([(1, 5), (2, 4), (2, 4), (3, 100), (4, 7), (5, 1)], "ord long, size long")
    got = lambda bound: sorted(r.ord for r in whole_rows_within(rows, "size", bound).collect())
    assert got(13) == [1, 2, 2] and got(20) == [1, 2, 2, 4] and got(21) == [1, 2, 2, 4, 5] and got(4) == [5]
    assert got(1000) == [1, 2, 2, 3, 4, 5]


def test_a_long_document_is_learned_whole(spark, monkeypatch):
    """All lines of a sampled document reach the fit."""
    docs = spark.createDataFrame([(i, ("good line of text\n" if i % 2 else "$$ ## !!\n") * 900) for i in range(1, 9)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, label int")
    field = line_quality.fit(docs, labels)
    got = {r.doc_id: r.predicted for r in line_quality.score(docs, field).collect()}
    assert got == {i: i % 2 for i in range(1, 9)}
    monkeypatch.setattr(line_quality, "SAMPLE_LINES", 900)  # not one document fits whole: nothing is learned
    assert {r.score for r in line_quality.score(docs, line_quality.fit(docs, labels)).collect()} == {0.5}
