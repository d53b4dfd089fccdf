"""Span extraction and span-level operators.

* ``adj_noun_spans``: adjective + head noun rule over any token table.
* ``classify_kinds``: nice-to-have if the span start lies in a marker sentence.
* ``combine_spans``: both extractors in one table with per-posting ordinals.
* ``span_counts`` / ``drafts``: per-posting summaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweave.config import RULE_EXTRACTOR, RULE_ID_INFIX
from skillweave.functions.text import has_marker
from skillweave.operators.sweep import BIN_CHARS, running_max

SPAN_COLUMNS = ["id", "posting_id", "span_ord", "text", "span_type", "char_start", "char_end",
                "extractor", "requirement_kind", "score"]


def adj_noun_spans(tokens: DataFrame, postings: DataFrame, key: str = "posting_id",
                   text_col: str = "raw_text", id_infix: str = RULE_ID_INFIX) -> DataFrame:
    """Adjective (dep nk/amod) + its NOUN/PROPN head, adjective not after the head, of any token table.

    Span = tokens adjective..head; text is the slice of the raw text (0-based offsets converted to 1-based
    ``substring`` here only). The default annotator's pairs come with their slices (``rule_spans``)."""
    a = (tokens.filter((F.col("pos") == "ADJ") & F.col("dep").isin("nk", "amod"))
         .select("posting_id", F.col("i").alias("a_i"), "head_i", "char_start"))
    heads = (tokens.filter(F.col("pos").isin("NOUN", "PROPN"))
             .select("posting_id", F.col("i").alias("head_i"), "char_end"))
    spots = (a.join(heads, ["posting_id", "head_i"]).filter(F.col("a_i") <= F.col("head_i"))
             .groupBy("posting_id").agg(F.array_sort(F.collect_list(F.struct("a_i", "char_start", "char_end"))).alias("s")))
    texts = postings.select(F.col(key).cast("string").alias("posting_id"), F.col(text_col).alias("raw_text"))
    cut = F.transform("s", lambda x: F.struct(
        x["char_start"].alias("char_start"), x["char_end"].alias("char_end"),
        F.substring(F.col("raw_text"), x["char_start"].cast("int") + 1, (x["char_end"] - x["char_start"]).cast("int"))
        .alias("text")))
    return rule_spans(spots.join(texts, "posting_id").select("posting_id", cut.alias("pairs")), id_infix)


def rule_spans(scanned: DataFrame, id_infix: str = RULE_ID_INFIX) -> DataFrame:
    """Spans of the rule from ``pairs`` (array of char_start, char_end, text in adjective order)."""
    spans = scanned.select("posting_id", F.posexplode("pairs").alias("n", "x"))
    return spans.select(
        F.concat_ws("-", "posting_id", F.lit(id_infix), (F.col("n") + 1).cast("string")).alias("id"),
        "posting_id",
        F.col("x.text").alias("text"),
        F.lit("skill").alias("span_type"),
        F.col("x.char_start").alias("char_start"), F.col("x.char_end").alias("char_end"),
        F.lit(RULE_EXTRACTOR).alias("extractor"),
        F.lit(None).cast("double").alias("score"),
        F.lit(0).alias("extractor_ord"),
        F.lit(0).alias("kind_ord"),
    )


def classify_kinds(spans: DataFrame, sentences: DataFrame, markers, bin_chars: int = BIN_CHARS) -> DataFrame:
    """requirement_kind = nice_to_have when some marker sentence holds the span start.

    Point-in-interval without pairing spans and sentences: marker sentences and
    spans are one stream per posting ordered by position; a span is inside a
    marker sentence iff its start is below the running maximum end of the
    marker sentences that start at or before it (a sweep in segments, so one long
    posting is many tasks).
    """
    return kinds_by_marked(spans, sentences.filter(has_marker("text", markers)), bin_chars)


def kinds_by_marked(spans: DataFrame, marked: DataFrame, bin_chars: int = BIN_CHARS) -> DataFrame:
    """``classify_kinds`` with the marker sentences (posting_id, char_start, char_end) already found."""
    marked = marked.select("posting_id", F.col("char_start").alias("p_"), F.lit(0).alias("t_"),
                           F.col("char_end").alias("m_end_"))
    tagged = spans.withColumn("p_", F.col("char_start")).withColumn("t_", F.lit(1))
    stream = tagged.unionByName(marked, allowMissingColumns=True)
    swept = running_max(stream, "p_", ["p_", "t_"], {"reach_": F.col("m_end_")}, bin_chars)
    kind = F.when(F.col("p_") < F.coalesce(F.col("reach_"), F.lit(-1)), "nice_to_have").otherwise("must")
    return (swept.filter(F.col("t_") == 1).withColumn("requirement_kind", kind)
            .drop("p_", "t_", "m_end_", "reach_"))


def combine_spans(rule_spans: DataFrame, tagged_spans: DataFrame) -> DataFrame:
    """UNION ALL of both extractors; span_ord = rule spans first, then tagger by kind, start."""
    u = rule_spans.unionByName(tagged_spans)
    w = Window.partitionBy("posting_id").orderBy("extractor_ord", "kind_ord", "char_start", "char_end", "id")
    return u.withColumn("span_ord", F.row_number().over(w).cast("long"))


def span_counts(spans: DataFrame, postings: DataFrame, extractors: list[str],
                key: str = "posting_id") -> DataFrame:
    """Spans per posting and extractor, zero where none."""
    counts = spans.groupBy("posting_id").pivot("extractor", extractors).count()
    base = postings.select(F.col(key).alias("posting_id"))
    out = base.join(counts, "posting_id", "left")
    return out.select("posting_id", *[F.coalesce(F.col(e), F.lit(0)).cast("long").alias(f"n_{e}")
                                      for e in extractors])


def drafts(postings: DataFrame, spans: DataFrame, key: str = "id") -> DataFrame:
    """Advert with its spans nested in span order; an advert without spans gets []."""
    fields = ["span_ord"] + [c for c in SPAN_COLUMNS if c not in ("posting_id", "span_ord")]
    nested = spans.groupBy("posting_id").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("span_candidates"))
    adverts = postings.select(F.col(key).alias("posting_id"), F.struct(*postings.columns).alias("raw_advertisement"))
    joined = adverts.join(nested, "posting_id", "left")
    empty = F.array().cast(nested.schema["span_candidates"].dataType)
    return joined.select(F.concat(F.lit("draft-"), "posting_id").alias("id"), "posting_id", "raw_advertisement",
                         F.coalesce("span_candidates", empty).alias("span_candidates"))
