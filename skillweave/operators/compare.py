"""Comparison reports: extractor overlap and totals, encoder top-1 margins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweave.functions.text import encoder_prefix
from skillweave.operators.encode import encoder_slot
from skillweave.operators.match import dense_top_k
from skillweave.operators.sweep import BIN_CHARS, running_max
from skillweave.session import written


def encoder_comparison(matches: DataFrame) -> DataFrame:
    """Per (model, query): top-1 concept and score, margin = top1 - top2 (null if k = 1)."""
    w = Window.partitionBy("model_id", "key").orderBy("rank")
    return (matches.withColumn("next_score", F.lead("score").over(w))
            .filter(F.col("rank") == 1)
            .select("model_id", "key", F.col("ord").alias("top1_ord"), F.col("score").alias("top1_score"),
                    (F.col("score") - F.col("next_score")).alias("margin")))


def encoders_on_texts(texts: DataFrame, concepts: DataFrame, encoders: dict, profiles: dict) -> DataFrame:
    """Per (model, text): the best concept, its label and score, and the margin to the second best, for several sentence
    encoders over the same texts (text) and concepts (ord, pref_label).

    ``encoders`` maps a model's name to its callable (list of texts -> vectors); the prefixes of ``profiles`` are put
    before texts and labels as each model wants them. Each distinct text and each label is encoded once by each model."""
    distinct = texts.select("text").distinct()
    asked, index, counted = None, None, None
    for name, encode in encoders.items():
        prefixed = lambda mode, c: F.concat(encoder_prefix(profiles, F.lit(name), mode), F.col(c)).alias("said")  # noqa: B023, E731
        q = encoder_slot(distinct.select(F.col("text").alias("key"), prefixed("query", "text")), encode, "key", "said", name)
        i = encoder_slot(concepts.select(F.col("ord").alias("key"), prefixed("passage", "pref_label")), encode, "key", "said", name)
        n = distinct.select(F.lit(name).alias("model_id"))
        asked, index, counted = ((a if b is None else b.unionByName(a)) for a, b in ((q, asked), (i, index), (n, counted)))
    index = written(index.withColumnRenamed("key", "ord"), "encoded-labels")
    best = encoder_comparison(dense_top_k(asked, index, 2, counted=counted))
    return best.join(concepts.select(F.col("ord").alias("top1_ord"), F.col("pref_label").alias("top1_label")), "top1_ord").select(
        "model_id", F.col("key").alias("text"), "top1_ord", "top1_label", "top1_score", "margin")


def extractor_overlap(spans: DataFrame, rule: str, tagger: str, bin_chars: int = BIN_CHARS) -> DataFrame:
    """Flag every span of either extractor that overlaps a span of the other.

    Overlap of [a.s, a.e) and [b.s, b.e): a.s < b.e and b.s < a.e (non-empty
    spans). Found without pairing: per posting, in start order, a span overlaps
    an earlier-or-equal-start span of the other side iff the running maximum of
    their ends exceeds its start, and a later-or-equal-start one iff the next
    start of the other side lies before its end. Both runs are sweeps in
    segments of ``bin_chars``.
    """
    s = spans.select("posting_id", "id", "extractor", "char_start", "char_end", "text", "span_type").filter(
        F.col("extractor").isin(rule, tagger))
    of = lambda name, c: F.when(F.col("extractor") == name, c)
    both = list(enumerate((rule, tagger)))
    seen = running_max(s, "char_start", ["char_start"], {f"reach_{i}": of(x, F.col("char_end")) for i, x in both}, bin_chars)
    # the next start is the greatest negated start from the end
    seen = running_max(seen, "char_start", [F.desc("char_start")], {f"next_{i}": of(x, -F.col("char_start")) for i, x in both},
                       bin_chars, backward=True)
    other = lambda c: F.when(F.col("extractor") == rule, F.col(f"{c}_1")).otherwise(F.col(f"{c}_0"))
    hit = (F.coalesce(other("reach") > F.col("char_start"), F.lit(False))
           | F.coalesce(-other("next") < F.col("char_end"), F.lit(False)))
    return seen.select(*s.columns, hit.alias("overlaps"))


def extractor_totals(overlap: DataFrame, postings: DataFrame, rule: str, tagger: str,
                     key: str = "id") -> DataFrame:
    """Per posting and overall (posting_id null): rule spans, tagger spans, overlapping rule spans."""
    base = postings.select(F.col(key).alias("posting_id"))
    joined = base.join(overlap, "posting_id", "left")
    return joined.rollup("posting_id").agg(
        F.count(F.when(F.col("extractor") == rule, 1)).alias("n_rule"),
        F.count(F.when(F.col("extractor") == tagger, 1)).alias("n_tagger"),
        F.count(F.when((F.col("extractor") == rule) & F.col("overlaps"), 1)).alias("n_overlap"),
    )
