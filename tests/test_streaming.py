"""Streaming front end: adverts arriving as JSON lines, one flow per micro-batch."""

import json
import os
import tempfile

from skillweave.operators import tagger
from skillweave.sources.concepts import read_concepts
from skillweave.streaming import adverts_stream


def test_stream_runs_flow_per_batch(spark, fix):
    src = tempfile.mkdtemp(prefix="adverts-in-")
    out = tempfile.mkdtemp(prefix="adverts-out-")
    items = json.load(open(fix("postings_sample.json"), encoding="utf-8"))
    with open(os.path.join(src, "batch1.json"), "w", encoding="utf-8") as fh:
        for it in items:
            fh.write(json.dumps(it, ensure_ascii=False) + "\n")
        fh.write(json.dumps({"id": "bad", "raw_text": "no fields"}) + "\n")
    concepts = read_concepts(spark, fix("concepts_small.json"))
    dic = tagger.label_dictionary(concepts)
    q = adverts_stream.start(spark, src, out, concepts, dic, tagger.dictionary_sizes(dic), ["skill"],
                             trigger_once=True)
    q.awaitTermination(300)
    m = spark.read.parquet(f"{out}/mappings")
    assert m.count() > 0
    assert set(r.posting_id for r in m.select("posting_id").distinct().collect()) <= {it["id"] for it in items}
    bad = spark.read.parquet(f"{out}/rejects").collect()
    assert [r.id for r in bad] == ["bad"] and bad[0].reasons.startswith("missing:source_uri")


def test_a_replayed_batch_leaves_the_same_rows(spark, fix):
    from skillweave.sources.adverts import read_raw
    out = tempfile.mkdtemp(prefix="adverts-replay-")
    concepts = read_concepts(spark, fix("concepts_small.json"))
    dic = tagger.label_dictionary(concepts)
    raw = read_raw(spark, fix("postings_sample.json"))
    spark.catalog.clearCache()
    rows = lambda: sorted(map(str, spark.read.parquet(f"{out}/mappings").collect()))
    for epoch in (0, 1, 1):
        adverts_stream.write_epoch(raw, epoch, out, concepts, dic, tagger.dictionary_sizes(dic), ["skill"])
        n = len(rows())
        assert not spark.sparkContext._jsc.getPersistentRDDs()
        if epoch == 0:
            once = n
    assert n == 2 * once
