"""Model slots (annotator, tagger, encoder) with stand-in models."""

import numpy as np
import pandas as pd

from skillweave.operators import annotate, encode, extract, match, tagger


def test_annotator_slot_feeds_rule_extractor_by_join(spark):
    post = spark.createDataFrame([("p", "ein sicherer Umgang")], "posting_id string, raw_text string")

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for pid, txt in zip(pdf.posting_id, pdf.raw_text):
            pos, start = ["DET", "ADJ", "NOUN"], 0
            for i, w in enumerate(txt.split(" ")):
                head = 2 if i == 1 else i
                rows.append((pid, i, w, pos[i], w.lower(), "nk" if i == 1 else "ROOT", head, start, start + len(w)))
                start += len(w) + 1
        return pd.DataFrame(rows, columns=annotate.TOKEN_COLUMNS)

    toks = annotate.annotator_slot(post, model)
    spans = extract.adj_noun_spans(toks, post).collect()
    assert [(s.text, s.char_start, s.char_end) for s in spans] == [("sicherer Umgang", 4, 19)]


def test_tagger_slot_output_merges(spark):
    post = spark.createDataFrame([("p", "Java, Python und SQL")], "posting_id string, raw_text string")

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([("p", "skill", 0, "Java,", 0, 5, 0.9), ("p", "skill", 1, "Python", 6, 12, 0.7)],
                            columns=tagger.HIT_COLUMNS)

    merged = tagger.merge_adjacent(tagger.strip_hits(tagger.tagger_slot(post, model))).collect()
    assert sorted((m.word, m.start, m.end) for m in merged) == [("Java", 0, 4), ("Python", 6, 12)]


def test_encoder_slot_into_dense_match(spark):
    texts = spark.createDataFrame([(1, "aa"), (2, "bb")], "key long, text string")
    concepts = spark.createDataFrame([(10, "aa"), (20, "bb")], "ord long, text string")

    def model(batch):
        return [[1.0, 0.0] if t == "aa" else [0.0, 2.0] for t in batch]

    q = encode.encoder_slot(texts, model, model_id="toy")
    idx = encode.encoder_slot(concepts.withColumnRenamed("ord", "key"), model, model_id="toy") \
        .withColumnRenamed("key", "ord")
    top = match.dense_top_k(q, idx, 1).collect()
    assert sorted((r.key, r.ord, round(r.score, 6)) for r in top) == [(1, 10, 1.0), (2, 20, 1.0)]


def test_models_in_the_flow_and_its_metadata(spark, fix):
    """Annotator, tagger and encoder callables run in the flow; each concept is encoded once; what ran is recorded."""
    import json

    from skillweave.config import DEFAULT
    from skillweave.plans.flow import Flow
    from skillweave.session import scratch_path
    from skillweave.sources import adverts, concepts, sinks

    def pos_model(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for pid, txt in zip(pdf.posting_id, pdf.raw_text):
            words, start = txt.split(" "), 0
            for i, w in enumerate(words):
                noun = i + 1 < len(words)
                rows.append((pid, i, w, "ADJ" if i % 2 == 0 and noun else "NOUN", w.lower(),
                             "nk" if i % 2 == 0 and noun else "ROOT", i + 1 if i % 2 == 0 and noun else i, start, start + len(w)))
                start += len(w) + 1
        return pd.DataFrame(rows, columns=annotate.TOKEN_COLUMNS)

    def tag_model(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(pid, "skill", 0, txt.split(" ")[0], 0, len(txt.split(" ")[0]), 0.9)
                for pid, txt in zip(pdf.posting_id, pdf.raw_text)]
        return pd.DataFrame(rows, columns=tagger.HIT_COLUMNS)

    seen = spark.sparkContext.accumulator(0)

    def sentence_model(texts):
        seen.add(len(texts))
        return [[1.0, len(t), t.count("e")] for t in texts]

    post = adverts.read_postings(spark, fix("postings_sample.json"))
    conc = concepts.read_concepts(spark, fix("concepts_small.json"))
    cache = scratch_path(spark, "vec-flow")
    dic = tagger.label_dictionary(conc)

    def flow():
        return Flow(post, conc, dic, tagger.dictionary_sizes(dic), ["skill"], DEFAULT.with_(encoder="toy"),
                    annotator=pos_model, tag=tag_model, encode=sentence_model, vector_cache=cache)
    f = flow()
    spans = f.spans.collect()
    assert {s.extractor for s in spans} == {"adj_noun", "tagger"}
    texts = {s.text for s in spans}
    maps = f.mappings.collect()
    assert len(maps) == 3 * len(spans)
    assert seen.value == 5 + len(texts)  # five concepts and each distinct text, once
    f.release()
    g = flow()
    assert g.mappings.count() == len(maps) and seen.value == 5 + 2 * len(texts)  # concepts came from the cache
    meta = json.loads(sinks.run_metadata(post, "sample", [], g.config, g.models()).first().parameters)
    assert (meta["encoder"], meta["annotator"], meta["extractors"]["tagger"]) == ("toy", "pos_model", "tag_model")
    g.release()
