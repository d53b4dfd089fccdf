"""Readers, validation, concept reader, vector cache, sinks."""

from pyspark.sql import functions as F

from skillweave.sources import adverts, concepts, sinks, vector_store
from skillweave.session import scratch_path


def test_json_object_and_array(spark, fix):
    one = adverts.read_postings(spark, fix("example_posting.json"))
    three = adverts.read_postings(spark, fix("postings_sample.json"))
    assert one.count() == 1 and three.count() == 3
    assert one.first().isco_group is None
    assert sorted(r.isco_group for r in three.collect()) == [2, 3, 3]


def test_validation_reports_missing_type_and_duplicates(spark):
    rows = [("a", "u", "2024-01-01", "x", "e", "2024-01-01", "t", "txt", "3"),
            ("a", "u2", "2024-01-01", "x", "e", "2024-01-01", "t", "txt", None),
            ("b", None, "2024-01-01", "x", "e", "01.01.2024", "t", "txt", "drei")]
    raw = spark.createDataFrame(rows, adverts._RAW)
    got = {(r.source_uri or ""): r.reasons for r in adverts.validate_postings(raw).collect()}
    assert got["u"] == "duplicate_id" and got["u2"] == "duplicate_id"
    valid = {r.source_uri: r.is_valid for r in adverts.validate_postings(raw).collect()}
    assert valid == {"u": True, "u2": True, None: False}
    assert got[""] == "missing:source_uri|bad_type:isco_group|bad_date:posting_date"


def test_concept_reader_defaults(spark, fix):
    c = concepts.read_concepts(spark, fix("concepts_small.json"))
    rows = c.collect()
    assert len(rows) == 5 and all(r.alt_labels is not None for r in rows)
    assert sorted(r.ord for r in rows) == [1, 2, 3, 4, 5]


def test_vector_cache_refresh_encodes_only_new(spark, fix):
    c = concepts.read_concepts(spark, fix("concepts_small.json"))
    path = scratch_path(spark, "vec-test")
    enc = vector_store.trigram_encoder()
    assert vector_store.refresh(spark, path, c, "trigram", enc) == 5
    assert vector_store.refresh(spark, path, c, "trigram", enc) == 0
    edited = c.withColumn("pref_label", F.when(F.col("ord") == 1, F.lit("Neu")).otherwise(F.col("pref_label")))
    assert vector_store.refresh(spark, path, edited, "trigram", enc) == 1
    assert vector_store.current_vectors(spark, path, edited, "trigram").count() == 5


def test_mapping_csv_roundtrip_string_order(spark):
    rows = [("p", "p-adjn-10", 'Text, mit "Quote"', "adj_noun", 1, "c", 0.3906, "rejected"),
            ("p", "p-adjn-2", "zwei\nZeilen", "adj_noun", 1, "c", 0.6907, "accepted")]
    m = spark.createDataFrame([(r[0], r[1], r[4], r[5], r[6], r[7]) for r in rows],
                              "posting_id string, span_id string, rank int, concept_uri string, score double, decision string")
    s = spark.createDataFrame([(r[1], r[2], r[3]) for r in rows], "id string, text string, extractor string")
    path = sinks.write_mapping_csv(sinks.mapping_review(m, s), scratch_path(spark, "csv-test"))
    back = sinks.read_mapping_csv(spark, path).collect()
    assert [r.span_id for r in back] == ["p-adjn-10", "p-adjn-2"]
    assert back[0].span_text == 'Text, mit "Quote"' and back[1].span_text == "zwei\nZeilen"
    assert back[0].score == "0.3906"


def test_accepted_and_rejected_are_all_rows(spark):
    rows = [("a", "u", "2024-01-01", "x", "e", "2024-01-01", "t", "txt", "3"), (None,) * 9, (None,) * 9,
            ("a", "u", "2024-01-01", "x", "e", "2024-01-01", "t", "txt", "3"),
            ("b", "u", "2024-01-01", "x", "e", "2024-01-32", "t", "txt", None)]
    raw = spark.createDataFrame(rows, adverts._RAW)
    # a date that is no date costs no advert
    assert adverts.accepted(raw).count() == 3 and adverts.rejected(raw).count() == 2
    assert {r.n_same_id for r in adverts.validate_postings(raw).filter("id is null").collect()} == {1}


def test_one_file_per_advert_is_named_after_it(spark, fix):
    import os

    from skillweave.config import DEFAULT
    from skillweave.operators import tagger
    from skillweave.plans.flow import Flow
    from skillweave.plans.run import run
    post = adverts.read_postings(spark, fix("postings_sample.json"))
    conc = concepts.read_concepts(spark, fix("concepts_small.json"))
    dic = tagger.label_dictionary(conc)
    spark.catalog.clearCache()
    paths = run(spark, Flow(post, conc, dic, tagger.dictionary_sizes(dic), ["skill"], DEFAULT), per_posting=True)
    ids = sorted(r.id for r in post.collect())
    ttl = sorted(f for f in os.listdir(paths["turtle"]) if f.endswith(".ttl"))
    assert ttl == [f"{i}.ttl" for i in ids]
    csv = sorted(f for f in os.listdir(paths["mappings_csv"]) if f.endswith("_mappings.csv"))
    assert csv and {c.removesuffix("_mappings.csv") for c in csv} <= set(ids)
    with open(os.path.join(paths["mappings_csv"], csv[0]), encoding="utf-8") as f:
        assert f.readline().strip() == "posting_id,span_id,span_text,extractor,rank,concept_uri,score,decision"
    back = sinks.read_mapping_csv(spark, os.path.join(paths["mappings_csv"], csv[0])).collect()
    assert {r.posting_id for r in back} == {csv[0].removesuffix("_mappings.csv")}
    meta = spark.read.json(paths["run_metadata"]).first()
    assert sum(p.endswith(".ttl") for p in meta.output_files) == len(ids)
    assert not spark.sparkContext._jsc.getPersistentRDDs()  # the run keeps nothing


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from skillweave import session

    class Bare:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda k, d: d)
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Bare)


def test_types_of_json_fields_are_seen(spark):
    import json
    import os
    import tempfile
    good = {"id": "a", "source_uri": "u", "crawl_date": "01.02.2024", "platform": "p", "employer": "e",
            "posting_date": "2024-01-01", "title": "t", "raw_text": "x \"y\"\nz ä", "isco_group": 3.0}
    lines = [json.dumps(x) for x in (
        good, good | {"id": "b", "isco_group": "7"}, good | {"id": "c", "title": 5}, good | {"id": "d", "raw_text": ["x"]},
        good | {"id": "e", "employer": {"n": 1}}, good | {"id": "f", "isco_group": 2.5}, good | {"id": "g", "isco_group": True},
        good | {"id": "h", "isco_group": 10**12}, good | {"id": "i", "isco_group": None}, good | {"id": None}, {"id": "k"})]
    lines += ['{"id": "cut', "[1]", "7", "", "  ", '{"id": "m"}}', '{"id": "n"} {"id": "o"}', '{"id": "q"},']
    folder = tempfile.mkdtemp(prefix="adverts-typed-")
    with open(os.path.join(folder, "x.json"), "w", encoding="utf-8") as f:
        f.write("\n".join(lines))
    raw = adverts.read_raw(spark, folder, multiline=False)
    ok = {r.id: (r.isco_group, r.crawl_date) for r in adverts.accepted(raw).collect()}
    assert ok == {"a": (3, "01.02.2024"), "b": (7, "01.02.2024"), "i": (None, "01.02.2024")}
    assert adverts.accepted(raw).where("id = 'a'").first().raw_text == good["raw_text"]
    bad = sorted((r.id or "", r.reasons, r.record) for r in adverts.rejected(raw).collect())
    assert [(i, x) for i, x, _ in bad if i and i != "k"] == [
        ("c", "bad_type:title"), ("d", "bad_type:raw_text"), ("e", "bad_type:employer"), ("f", "bad_type:isco_group"),
        ("g", "bad_type:isco_group"), ("h", "bad_type:isco_group")]
    assert [(x, t) for i, x, t in bad if not i] == [
        ("bad_json", '{"id": "cut'), ("bad_json", '{"id": "m"}}'), ("bad_json", '{"id": "n"} {"id": "o"}'),
        ("bad_json", '{"id": "q"},'), ("bad_type:record", "7"),
                                                   ("bad_type:record", "[1]"), ("missing:id", None)]
    assert next(x for i, x, _ in bad if i == "k").startswith("missing:source_uri|missing:crawl_date")
    odd = {r.id: (r.is_valid, r.reasons) for r in adverts.validate_postings(raw).collect()}
    assert odd["a"] == (True, "bad_date:crawl_date")


def test_an_array_of_a_file_is_split_and_a_broken_file_is_a_reject(spark):
    import os
    import tempfile
    folder = tempfile.mkdtemp(prefix="adverts-array-")
    for name, text in (("a", '[{"id": "x"}, 5, {"id": 6}]'), ("b", '[{"id": '), ("c", "[]")):
        with open(os.path.join(folder, f"{name}.json"), "w", encoding="utf-8") as f:
            f.write(text)
    got = sorted((r.id or "", r.reasons.split("|")[0]) for r in adverts.rejected(adverts.read_raw(spark, folder)).collect())
    assert got == [("", "bad_json"), ("", "bad_type:id"), ("", "bad_type:record"), ("x", "missing:source_uri")]


def test_typed_columns_of_parquet(spark):
    path = scratch_path(spark, "typed-adverts")
    spark.createDataFrame([("a", "u", "d", "p", "e", "d", 5, "x", 3.0), ("b", "u", "d", "p", "e", "d", None, "x", 3.5)],
                          "id string, source_uri string, crawl_date string, platform string, employer string, posting_date string, "
                          "title long, raw_text string, isco_group double").write.parquet(path)
    got = {r.id: r.reasons for r in adverts.rejected(adverts.read_raw(spark, path, "parquet")).collect()}
    assert got == {"a": "bad_type:title", "b": "missing:title|bad_type:isco_group"}


def test_a_text_is_parsed_once_for_all_its_fields(spark):
    """Filters and fields on top of the reader took a copy of the parser each, 1,115 of them."""
    from skillweave.sources.adverts import accepted, parsed, quality, rejected
    raw = parsed(spark.createDataFrame([('{"id": "a"}',)], "value string").repartition(2))
    for df in (accepted(raw).withColumn("quality", quality()), rejected(raw)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.lower().count("variant_get") < 100
