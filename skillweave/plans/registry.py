"""Registered queries: one per operator of the inventory, over the driver tables.

Every callable takes (spark, sf_dir) and returns a DataFrame whose column
names equal those of the matching oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.config import DEFAULT
from skillweave.operators import tagger
from skillweave.plans import bindings as B
from skillweave.plans.flow import Flow

#: The flow of the last session and data folder that were asked for.
_FLOWS: dict = {}


def flow(spark: SparkSession, sf_dir: str) -> Flow:
    """The flow of a data folder. Queries over the same folder share it; one over another folder, or of another session,
    frees what the one before keeps."""
    key = (spark.sparkContext.applicationId, spark._jsparkSession.sessionUUID(), sf_dir)
    if key not in _FLOWS:
        for (application, _, _), old in _FLOWS.items():
            if application == key[0]:  # another one's data went with it
                old.release()
        _FLOWS.clear()
        bench = B.table(spark, sf_dir, "benchmark")
        dic = None
        for model in B.TAGGER_MODELS:
            d = tagger.gram_dictionary(bench, B.TAGGER_SIZES[model], model)
            dic = d if dic is None else dic.unionByName(d)
        _FLOWS[key] = Flow(
            postings=B.spread(B.postings(spark, sf_dir)),
            concepts=B.concepts(spark, sf_dir),
            dictionary=dic,
            tagger_sizes=sorted(B.TAGGER_SIZES.items()),
            tagger_models=B.TAGGER_MODELS,
            config=DEFAULT.with_(markers=B.TEST_MARKERS, threshold=B.SPARSE_THRESHOLD),
        )
    return _FLOWS[key]


def q_postings(spark, sf):
    return B.postings(spark, sf)


def q_tokens(spark, sf):
    return flow(spark, sf).tokens


def q_marker_sentences(spark, sf):
    from skillweave.functions.text import has_marker
    s = flow(spark, sf).sentences
    return s.withColumn("is_marked", has_marker("text", B.TEST_MARKERS))


def q_adj_noun_spans(spark, sf):
    return flow(spark, sf).rule_spans.drop("extractor_ord", "kind_ord")


def q_tagger_hits(spark, sf):
    return flow(spark, sf).hits


def q_tagger_raw_hits(spark, sf):
    return flow(spark, sf).raw_hits


def q_tagger_spans(spark, sf):
    return flow(spark, sf).tagged_spans.drop("extractor_ord", "kind_ord")


def q_spans(spark, sf):
    return flow(spark, sf).spans.drop("extractor_ord", "kind_ord")


def q_span_counts(spark, sf):
    return flow(spark, sf).span_counts


def q_drafts(spark, sf):
    d = flow(spark, sf).drafts
    return d.select("id", "posting_id", F.size("span_candidates").cast("long").alias("n_spans"),
                    F.array_join(F.transform("span_candidates", lambda s: s["id"]), "|").alias("span_ids"),
                    F.col("raw_advertisement.title").alias("title"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "postings": q_postings,
    "tokens": q_tokens,
    "marker_sentences": q_marker_sentences,
    "adj_noun_spans": q_adj_noun_spans,
    "tagger_raw_hits": q_tagger_raw_hits,
    "tagger_hits": q_tagger_hits,
    "tagger_spans": q_tagger_spans,
    "spans": q_spans,
    "span_counts": q_span_counts,
    "drafts": q_drafts,
}


def q_sparse_matches(spark, sf):
    """Distinct span texts matched to benchmark concepts (trigram cosine, top-3)."""
    from skillweave.operators.match import decide, sparse_top_k
    f = flow(spark, sf)
    texts = f.spans.select("text").distinct().select(F.col("text").alias("key"), "text")
    top = decide(sparse_top_k(texts, f.concepts, f.config.top_k), f.config.threshold)
    return top.select(F.col("key").alias("text"), F.col("rank").cast("int").alias("rank"),
                      F.col("ord").alias("concept_ord"), F.round("score", 4).alias("score"), "decision")


def q_mappings(spark, sf):
    from skillweave.operators.requirements import MAPPING_COLUMNS
    m = flow(spark, sf).mappings.select(*MAPPING_COLUMNS)
    return m.withColumn("score", F.round("score", 4))


def q_accepted_spans(spark, sf):
    a = flow(spark, sf).accepted
    return a.select("id", "posting_id", "span_ord", "requirement_kind", "concept_uri",
                    F.round("mapping_score", 4).alias("mapping_score"))


def q_requirements(spark, sf):
    r = flow(spark, sf).requirements
    return r.withColumn("provenance_confidence", F.round("provenance_confidence", 4))


QUERIES.update({
    "sparse_matches": q_sparse_matches,
    "mappings": q_mappings,
    "accepted_spans": q_accepted_spans,
    "requirements": q_requirements,
})


def _dense(spark, sf, model: str | None = None):
    from skillweave.operators.match import dense_top_k
    q, idx = B.dense_vectors(spark, sf)
    if model is not None:
        q, idx = q.filter(F.col("model_id") == model), idx.filter(F.col("model_id") == model)
    return dense_top_k(q, idx.select("model_id", F.col("key").alias("ord"), "vec"), DEFAULT.top_k, exclude_self=True)


def q_dense_matches(spark, sf):
    from skillweave.operators.match import decide
    m = decide(_dense(spark, sf), B.DENSE_THRESHOLD)
    return m.select("model_id", F.col("key").alias("query_id"), F.col("rank").cast("int").alias("rank"),
                    F.col("ord").alias("concept_id"), F.round("score", 4).alias("score"), "decision")


def q_encoder_comparison(spark, sf):
    from skillweave.operators.compare import encoder_comparison
    c = encoder_comparison(_dense(spark, sf))
    return c.select("model_id", F.col("key").alias("query_id"), F.col("top1_ord").alias("top1_concept"),
                    F.round("top1_score", 4).alias("top1_score"), F.round("margin", 4).alias("margin"))


def q_encoder_texts(spark, sf):
    """Two encoders compared on the distinct span texts and the concepts' labels."""
    from skillweave.operators.compare import encoders_on_texts
    f = flow(spark, sf)
    c = encoders_on_texts(f.spans, f.concepts, B.ENCODERS, DEFAULT.encoder_profiles)
    return c.select("model_id", "text", F.col("top1_ord").alias("top1_concept"), "top1_label",
                    F.round("top1_score", 4).alias("top1_score"), F.round("margin", 4).alias("margin"))


def q_dense_requirements(spark, sf):
    """Consolidation fold on dense top-1 matches, 50 neighbouring vectors making a posting."""
    from skillweave.operators.requirements import consolidate
    m = _dense(spark, sf, "plain").filter((F.col("rank") == 1) & (F.col("score") >= B.DENSE_FOLD_THRESHOLD))
    acc = m.select(
        F.floor(F.col("key") / 50).cast("string").alias("posting_id"),
        F.col("key").alias("span_ord"),
        F.col("key").cast("string").alias("id"),
        (F.col("ord") % 7).cast("string").alias("concept_uri"),
        F.col("score").alias("mapping_score"),
        F.when((F.floor(F.col("key") / 5) % 2) == 0, "must").otherwise("nice_to_have").alias("requirement_kind"),
    )
    groups = acc.select(F.col("posting_id").alias("id"), F.lit(None).cast("int").alias("isco_group")).distinct()
    r = consolidate(acc, groups, DEFAULT.level_map, DEFAULT.fallback_level)
    return r.select("posting_id", "req_ord", "refers_to_competence", "requirement_kind",
                    F.round("provenance_confidence", 4).alias("provenance_confidence"), "span_id")


QUERIES.update({
    "dense_matches": q_dense_matches,
    "encoder_comparison": q_encoder_comparison,
    "encoder_texts": q_encoder_texts,
    "dense_requirements": q_dense_requirements,
})


def q_extractor_overlap(spark, sf):
    return flow(spark, sf).overlap


def q_extractor_totals(spark, sf):
    from skillweave.operators.compare import extractor_totals
    f = flow(spark, sf)
    return extractor_totals(f.overlap, f.facts, "adj_noun", f.config.tagger_name)


def q_stage_counts(spark, sf):
    return flow(spark, sf).stage_counts


def q_isco_levels(spark, sf):
    from skillweave.functions.levels import level_is_fallback, required_level
    p = B.postings(spark, sf)
    return p.select("id", "isco_group", required_level("isco_group").alias("required_level"),
                    level_is_fallback("isco_group").alias("level_is_fallback"))


def q_concepts(spark, sf):
    c = B.concepts(spark, sf)
    return c.select("uri", "pref_label", F.size("alt_labels").cast("long").alias("n_alt_labels"), "definition", "ord")


def q_encoder_inputs(spark, sf):
    from skillweave.operators.encode import encoder_inputs
    b = B.table(spark, sf, "benchmark")
    return encoder_inputs(b, "item_id", "text", list(DEFAULT.encoder_profiles), DEFAULT.encoder_profiles)


def q_page_keys(spark, sf):
    from skillweave.sources.adverts import page_postings
    from skillweave.functions import text as T
    p = page_postings(B.table(spark, sf, "pages"))
    return p.select(
        "id", F.col("source_uri").alias("url"),
        T.posting_key("source_uri").alias("posting_key"),
        T.posting_uuid("source_uri").alias("posting_uuid"),
        T.employer_slug("employer").alias("employer_slug"),
        T.employer_slug("title").alias("title_slug"),
        F.concat(F.lit("draft-"), "id").alias("draft_id"),
        F.concat(F.lit(DEFAULT.data_ns + "req_"), T.posting_key("source_uri"), F.lit("_")).alias("req_uri_prefix"),
    )


def q_posting_checks(spark, sf):
    from skillweave.sources.adverts import validate_postings
    return validate_postings(B.raw_pages(spark, sf))


def _raw_from_json(spark, sf):
    """Raw adverts, faults among them, written as JSON lines and read by the reader."""
    from skillweave.session import scratch_path
    from skillweave.sources.adverts import read_raw
    path = scratch_path(spark, "adverts-json")
    B.json_lines(spark, sf).write.text(path)
    return read_raw(spark, path, multiline=False)


def q_postings_json(spark, sf):
    """The valid adverts of JSON lines, typed, with what is odd about them."""
    from skillweave.sources.adverts import accepted, quality
    return accepted(_raw_from_json(spark, sf)).withColumn("quality", quality())


def q_rejects(spark, sf):
    """The other lines, with their reasons, and the text of those that are no JSON object."""
    from skillweave.sources.adverts import rejected
    return rejected(_raw_from_json(spark, sf)).select("id", "source_uri", "reasons", "record")


def q_concepts_json(spark, sf):
    """Concepts written as JSON lines and read by the reader."""
    from skillweave.session import scratch_path
    from skillweave.sources.concepts import read_concepts
    path = scratch_path(spark, "concepts-json")
    B.concepts(spark, sf).drop("alt_labels", "ord").write.json(path)
    c = read_concepts(spark, path, multiline=False)
    return c.select("uri", "pref_label", F.size("alt_labels").cast("long").alias("n_alt_labels"), "definition", "ord")


QUERIES.update({
    "extractor_overlap": q_extractor_overlap,
    "extractor_totals": q_extractor_totals,
    "stage_counts": q_stage_counts,
    "isco_levels": q_isco_levels,
    "concepts": q_concepts,
    "encoder_inputs": q_encoder_inputs,
    "page_keys": q_page_keys,
    "posting_checks": q_posting_checks,
    "postings_json": q_postings_json,
    "rejects": q_rejects,
    "concepts_json": q_concepts_json,
})


def q_triples(spark, sf):
    return flow(spark, sf).triples


def q_validation_report(spark, sf):
    from skillweave.operators.shapes import constraints, validate
    return validate(B.inject_faults(flow(spark, sf).triples), constraints(spark))


def q_conforms(spark, sf):
    """Whether the graph as delivered, and the one with faults, conform to the constraints."""
    from skillweave.operators.shapes import conforms, constraints, validate
    tr = flow(spark, sf).triples
    out = None
    for name, graph in (("delivered", tr), ("faulty", B.inject_faults(tr))):
        part = conforms(validate(graph, constraints(spark))).select(F.lit(name).alias("graph"), "conforms", "n_violations")
        out = part if out is None else out.unionByName(part)
    return out


def q_mappings_dense_flow(spark, sf):
    """The flow with a dense encoder in its slot and concept vectors from a fresh cache."""
    from skillweave.operators.requirements import MAPPING_COLUMNS
    from skillweave.session import scratch_path
    f = flow(spark, sf).fresh()
    f.config = f.config.with_(encoder="hashed-trigrams")
    f.encode, f.vector_cache = B.hashed_trigrams, scratch_path(spark, "vectors")
    return f.mappings.select(*MAPPING_COLUMNS).withColumn("score", F.round("score", 4))


def q_turtle_documents(spark, sf):
    return flow(spark, sf).turtle


def q_spans_by_reader(spark, sf):
    """Spans with a text model in the reader's slot, whose sentences (lines) decide the kind."""
    f = flow(spark, sf).fresh()
    f.reader = B.line_reader
    return f.spans.drop("extractor_ord", "kind_ord")


def q_tagger_windowed_hits(spark, sf):
    """Hits of a tagger that reads 50 words at a time, stitched over whole texts."""
    f = flow(spark, sf).fresh()
    f.tag, f.tag_window = B.noun_tagger, (50, B.NEAR)
    return f.hits


QUERIES.update({
    "spans_by_reader": q_spans_by_reader,
    "tagger_windowed_hits": q_tagger_windowed_hits,
    "triples": q_triples,
    "validation_report": q_validation_report,
    "turtle_documents": q_turtle_documents,
    "conforms": q_conforms,
    "mappings_dense_flow": q_mappings_dense_flow,
})


def q_mapping_review(spark, sf):
    """Review CSV of all mappings, written (sharded) and read back."""
    from skillweave.session import scratch_path
    from skillweave.sources import sinks
    f = flow(spark, sf)
    path = sinks.write_mapping_csv(sinks.mapping_review(f.mappings, f.spans), scratch_path(spark, "review"))
    return sinks.read_mapping_csv(spark, path)


def q_run_metadata(spark, sf):
    """A whole run's metadata, read back: the counts of its stages, its parameters, and the rows of its files (times and
    paths left out)."""
    from skillweave.plans.run import run
    paths = run(spark, flow(spark, sf).fresh(), input_desc="documents", concepts_desc="benchmark")
    m = spark.read.json(paths["run_metadata"])
    params = F.from_json("parameters", "mapping_threshold double, mapping_top_k long, encoder string")
    sinks = F.array_distinct(F.transform("output_files", lambda x: F.element_at(F.split(x, "/"), -2)))
    rows = spark.read.parquet(paths["files"])
    stored = lambda t: rows.where(F.col("sink") == t).agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar().alias(f"rows_{t}")
    return m.select("pipeline_version", "input", "posting_count", "n_tokens", "n_sentences", "n_spans", "n_mappings",
                    "n_accepted", "n_requirements", "n_triples", F.array_join(F.sort_array(sinks), "|").alias("sinks"),
                    params["mapping_threshold"].alias("mapping_threshold"),
                    params["mapping_top_k"].alias("mapping_top_k"), params["encoder"].alias("encoder"),
                    *[stored(t) for t in ("spans", "mappings", "requirements", "stage_counts", "triples")])


def q_vector_cache(spark, sf):
    """Concept vectors cached, labels edited, refreshed: only valid entries are served."""
    from skillweave.session import scratch_path
    from skillweave.sources import vector_store as V
    c = B.concepts(spark, sf)
    path = scratch_path(spark, "vectors")
    enc = V.trigram_encoder("trigram")
    V.refresh(spark, path, c.withColumn("pref_label", F.upper("pref_label")), "trigram", enc)
    V.refresh(spark, path, c, "trigram", enc)
    V.refresh(spark, path, c, "trigram", enc)  # nothing new: all keys present
    V.compact(spark, path)
    versions = V.table(spark, path).groupBy("uri").agg(F.count(F.lit(1)).alias("n_versions"))
    cur = V.current_vectors(spark, path, c, "trigram")
    return cur.join(versions, "uri").select("model_id", "uri", "label_hash", F.size("terms").cast("long").alias("n_terms"),
                                            F.round("norm", 6).alias("norm"), "n_versions")


def q_full_run(spark, sf):
    """End to end: every sink written; the requirements table read back."""
    from skillweave.plans.run import run
    f = flow(spark, sf)
    paths = run(spark, f.fresh(), input_desc="documents", concepts_desc="benchmark")
    r = spark.read.parquet(paths["requirements"])
    return r.withColumn("provenance_confidence", F.round("provenance_confidence", 4))


def flagship(spark, sf):
    return q_full_run(spark, sf)


QUERIES.update({
    "mapping_review": q_mapping_review,
    "run_metadata": q_run_metadata,
    "vector_cache": q_vector_cache,
    "full_run": q_full_run,
})
