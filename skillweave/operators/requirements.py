"""From spans to mappings to qualification requirements.

``map_spans``: each distinct span text is matched once (dedup before the
encoder); the k matches are joined back to every span with that text through a
salted join, so a text shared by a third of all spans is spread over many tasks.

``consolidate``: per (posting, concept) an ordered fold over the accepted
spans in span order - replace the current winner when the next score is
strictly higher, or when the current one is nice-to-have and the next is a
must. Not an arg-max: the order matters. Requirements are numbered by the
span order of the first accepted span of each concept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweave.functions.levels import level_is_fallback, required_level
from skillweave.functions.text import encoder_prefix, short_hash
from skillweave.operators.encode import encoder_slot
from skillweave.operators.fold import CHUNK, ordered_fold
from skillweave.operators.match import decide, dense_top_k, sparse_top_k
from skillweave.session import written


def salted_join(big: DataFrame, small: DataFrame, on: str, salt_of: str, buckets: int,
                how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` with the big side spread over ``buckets`` salts.

    The small side (k rows per key) is replicated once per salt; a hot key of
    the big side lands in ``buckets`` tasks instead of one.
    """
    b = big.withColumn("salt_", F.pmod(F.xxhash64(salt_of), F.lit(buckets)))
    s = small.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return b.join(s, [on, "salt_"], how).drop("salt_")


def map_spans(spans: DataFrame, concepts: DataFrame, top_k: int, threshold: float,
              encoder: str = "trigram", profiles: dict | None = None, salt_buckets: int = 16,
              encode=None, vectors: DataFrame | None = None) -> DataFrame:
    """Mappings (id, span_id, posting_id, concept_uri, score, decision, rank) for every span.

    Without ``encode`` texts are matched by trigrams. With it (list of texts -> vectors) they are matched by their
    vectors against ``vectors`` (ord, vec) of the concepts, or against freshly encoded labels."""
    profiles = profiles or {}
    texts = spans.select("text").distinct()
    q = texts.select(F.col("text").alias("key"),
                     F.concat(encoder_prefix(profiles, F.lit(encoder), "query"), F.col("text")).alias("qtext"))
    c = concept_passages(concepts, encoder, profiles)
    if encode is None:
        top = sparse_top_k(q, c, top_k, q_key="key", q_text="qtext")
    else:
        index = vectors if vectors is not None else written(encoder_slot(c, encode, "ord", "pref_label", encoder).select(
            F.col("key").alias("ord"), "vec"), "concept-vectors")
        top = dense_top_k(encoder_slot(q, encode, "key", "qtext", encoder).drop("model_id"), index.select("ord", "vec"),
                          top_k, counted=q)
    uris = concepts.select("ord", F.col("uri").alias("concept_uri"))
    matches = decide(top.join(uris, "ord"), threshold).withColumnRenamed("key", "text")
    # span_ord and requirement_kind ride along, so consolidation needs no second span join
    carry = [c for c in ("span_ord", "requirement_kind") if c in spans.columns]
    joined = salted_join(spans.select(F.col("id").alias("span_id"), "posting_id", "text", *carry), matches, "text",
                         "span_id", salt_buckets)
    return joined.select(
        F.concat(F.lit("mapping-"), short_hash("span_id", F.col("rank").cast("string"))).alias("id"),
        "span_id", "posting_id", "concept_uri", F.col("score").cast("double").alias("score"), "decision",
        F.col("rank").cast("int").alias("rank"), *carry,
    )


def concept_passages(concepts: DataFrame, encoder: str, profiles: dict) -> DataFrame:
    """(uri, ord, pref_label) with the encoder's passage prefix before the label."""
    return concepts.select("uri", "ord", F.concat(encoder_prefix(profiles, F.lit(encoder), "passage"),
                                                  F.col("pref_label")).alias("pref_label"))


MAPPING_COLUMNS = ["id", "span_id", "posting_id", "concept_uri", "score", "decision", "rank"]


def accepted_from_mappings(mappings: DataFrame) -> DataFrame:
    """Accepted mappings in the consolidation input shape."""
    return (mappings.filter(F.col("decision") == "accepted")
            .select("posting_id", "span_ord", F.col("span_id").alias("id"), "concept_uri",
                    F.col("score").alias("mapping_score"), "requirement_kind"))


def accepted_spans(spans: DataFrame, mappings: DataFrame) -> DataFrame:
    """Spans joined with their accepted mapping; spans without one drop out."""
    acc = mappings.filter(F.col("decision") == "accepted").select(  # posting_id comes from spans
        F.col("span_id").alias("id"), "concept_uri", F.col("score").alias("mapping_score"))
    return spans.join(acc, "id")


def consolidate(accepted: DataFrame, postings: DataFrame, level_map: dict, fallback: str,
                key: str = "id", chunk: int = CHUNK) -> DataFrame:
    """Requirements per (posting, concept) by the ordered fold, merged from summaries of chunks (``fold``).

    accepted: (posting_id, span_ord, id, concept_uri, mapping_score, requirement_kind).
    """
    won = ordered_fold(accepted, ["posting_id", "concept_uri"], "span_ord", "mapping_score",
                       F.col("requirement_kind") == "must", "id", chunk)
    w = Window.partitionBy("posting_id").orderBy("first_ord")
    levels = postings.select(F.col(key).alias("posting_id"), "isco_group")
    out = (won.withColumnRenamed("id", "span_id").withColumn("req_ord", F.row_number().over(w).cast("long"))
           .join(levels, "posting_id"))
    return out.select(
        F.concat(F.lit("req-"), short_hash("posting_id", "concept_uri")).alias("id"),
        "posting_id", "req_ord",
        F.col("concept_uri").alias("refers_to_competence"),
        required_level("isco_group", level_map, fallback).alias("required_level"),
        level_is_fallback("isco_group", level_map).alias("level_is_fallback"),
        F.when(F.col("must"), "must").otherwise("nice_to_have").alias("requirement_kind"),
        F.col("score").alias("provenance_confidence"),
        F.col("span_id"),
    )
