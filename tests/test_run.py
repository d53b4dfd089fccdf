"""The run: counters without a further pass over texts, real files, and a restart after the last whole stage."""

import json

import pytest
from pyspark.sql import functions as F

from skillweave.config import DEFAULT
from skillweave.operators import annotate, tagger
from skillweave.plans import run as run_module
from skillweave.plans.flow import Flow
from skillweave.session import scratch_path
from skillweave.sources import adverts, concepts, sinks


@pytest.fixture
def flow(spark, fix):
    post = adverts.read_postings(spark, fix("postings_sample.json"))
    conc = concepts.read_concepts(spark, fix("concepts_small.json"))
    dic = tagger.label_dictionary(conc)
    return lambda config=DEFAULT: Flow(post, conc, dic, tagger.dictionary_sizes(dic), ["skill"], config)


def counting_scan(monkeypatch):
    calls, real = [], annotate.scan
    monkeypatch.setattr(annotate, "scan", lambda *a, **k: calls.append(1) or real(*a, **k))
    return calls


def test_a_failed_sink_is_resumed_without_a_second_scan(spark, flow, monkeypatch):
    out, scans = scratch_path(spark, "resume"), counting_scan(monkeypatch)
    real = sinks.write_text

    def broken(lines, path, *a, **k):
        if path.endswith("turtle"):
            raise OSError("no space")
        return real(lines, path, *a, **k)
    monkeypatch.setattr(sinks, "write_text", broken)
    with pytest.raises(OSError):
        run_module.run(spark, flow(), out)
    assert len(scans) == 1
    monkeypatch.setattr(sinks, "write_text", real)
    ran, once = [], run_module.Stages.once
    monkeypatch.setattr(run_module.Stages, "once", lambda self, name, write: once(
        self, name, lambda: ran.append(name) or write()))
    paths = run_module.run(spark, flow(), out)
    assert ran == ["turtle", "run_metadata"] and len(scans) == 1
    fresh = run_module.run(spark, flow(), scratch_path(spark, "whole"))
    for name in ("requirements", "triples", "stage_counts"):
        rows = lambda p: sorted(map(str, spark.read.parquet(p).collect()))
        assert rows(paths[name]) == rows(fresh[name])
    got, want = (spark.read.json(p["run_metadata"]).drop("run_timestamp", "output_files").first().asDict() for p in (paths, fresh))
    assert got == want and got["n_spans"] > 0
    ran.clear()
    run_module.run(spark, flow(), out)
    assert ran == []
    run_module.run(spark, flow(DEFAULT.with_(threshold=0.9)), out)  # other parameters: all anew
    assert len(ran) == 10 and len(scans) == 3


def test_counts_and_files_of_the_metadata(spark, flow):
    f = flow()
    tokens, sentences = f.tokens.count(), f.sentences.count()
    paths = run_module.run(spark, f)
    m = spark.read.json(paths["run_metadata"]).first()
    assert (m.n_tokens, m.n_sentences, m.posting_count) == (tokens, sentences, 3)
    total = spark.read.parquet(paths["stage_counts"]).agg(*[F.sum(c).alias(c) for c in (
        "n_tokens", "n_sentences", "n_spans", "n_mappings", "n_accepted", "n_requirements")]).first()
    assert all(total[c] == m[c] for c in total.asDict())
    import os
    assert m.output_files and all(os.path.exists(p.removeprefix("file:")) for p in m.output_files)
    assert m.run_timestamp.endswith("+00:00") and json.loads(m.parameters)["mapping_top_k"] == 3


@pytest.mark.parametrize("text", ["", "a", ".", "...", "a. b", "\n\n", "Ä ö 漢字 12 a1b2, x!?\n y", "😀𝒜x 𐐀b", "a\tb\x0bc", "end. ", "(x)"])
def test_counting_equals_cutting(text):
    assert annotate.piece_counts(text) == (len(annotate._tokens(text)), len(annotate.SENTENCE.findall(text)))


def test_counting_equals_cutting_on_the_documents(spark):
    import pandas as pd
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")["text"]
    for text in docs.fillna(""):
        assert annotate.piece_counts(text) == (len(annotate._tokens(text)), len(annotate.SENTENCE.findall(text)))
