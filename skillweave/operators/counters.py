"""Stage counters per posting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ("n_tokens", "n_sentences", "n_spans", "n_mappings", "n_accepted", "n_requirements")


def text_counts(flow) -> DataFrame:
    """(posting_id, n_tokens, n_sentences) of every advert, as the scan that finds the spans counted them. The tokens of
    an annotator, or both of a reader, in the flow's slots are counted from their rows."""
    if flow.reader is not None:
        of = lambda part: F.count(F.when(F.col("part") == part, 1))
        own = flow.parts.groupBy("posting_id").agg(of("token").alias("n_tokens"), of("sentence").alias("n_sentences"))
        return (flow.facts.select(F.col("id").alias("posting_id")).join(own, "posting_id", "left")
                .select("posting_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tokens", "n_sentences")]))
    scanned = flow.scanned.select("posting_id", "n_tokens", "n_sentences")
    if flow.annotator is None:
        return scanned
    own = flow.tokens.groupBy("posting_id").agg(F.count("*").alias("n_tokens"))
    return (scanned.drop("n_tokens").join(own, "posting_id", "left")
            .select("posting_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "n_sentences"))


def stage_counts(flow, texts: DataFrame | None = None) -> DataFrame:
    """tokens, sentences, spans, mappings, accepted mappings, requirements per posting (0 if none): one union of
    (posting, stage) rows and one aggregation, partial in each task. No text is read for it but by the scan, whose
    counts ``texts`` are if they have been written."""
    accepted = (F.col("decision") == "accepted").cast("long")
    parts = [
        text_counts(flow) if texts is None else texts,
        flow.spans.select("posting_id", F.lit(1).cast("long").alias("n_spans")),
        flow.mappings.select("posting_id", F.lit(1).cast("long").alias("n_mappings"), accepted.alias("n_accepted")),
        flow.requirements.select("posting_id", F.lit(1).cast("long").alias("n_requirements")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy("posting_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in STAGES])
