"""Mixing sources to target weights: repetition rates per source, floor(rate) copies and one Bernoulli copy.

Words are summed per source (partial aggregation, so a source with a third of all rows costs one row per task).
Targets share ``SHARE`` of all words by weight; a source stops at ``CAP`` times its size and its excess is shared
again by weight. A document's copies are floor(rate) plus one if a hash of its doc_id falls under the fraction, so
reruns and retried tasks agree.

Defined results: a null text has no words; null is a source of its own, sorted last; sources without words have
target 0 and their documents rate 0; repeated rows with one doc_id share their draw, and so do rows without one; an
empty table gives no rows. Sources capped at the same level go in code-point order. Texts of any length are taken whole.
Extra columns pass through; columns called size, source_size, target or copies give way to those made here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.llm.common import written

#: Weights by position of the source in code-point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
SEED = 7


def n_words(column: str = "text"):
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source.

    Resharing ends with target = min(cap * size, weight * level) for one level. Sources are ordered by the level at
    which they are capped (cap * size / weight); the first k of them are capped where that level does not exceed
    what remains, shared by the remaining weight."""
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.col("at").cast("int"))
    ranked = sizes.selectExpr("source", "source_size", f"(row_number() over (order by source nulls last) - 1) "
                                                       f"% {len(weights)} + 1 as at")
    ranked = ranked.withColumn("weight", weight).withColumn("stop", F.col("source_size") * cap)
    ranked = ranked.selectExpr(
        "source", "source_size", "weight", "stop",
        f"sum(source_size) over () * {share}D as total", "sum(weight) over () as all_weight",
        "coalesce(sum(stop) over (order by stop / weight, source nulls last "
        "rows between unbounded preceding and 1 preceding), 0) as stopped",
        "coalesce(sum(weight) over (order by stop / weight, source nulls last "
        "rows between unbounded preceding and 1 preceding), 0) as stopped_weight")
    level = "(total - stopped) / (all_weight - stopped_weight)"
    ranked = ranked.selectExpr("*", f"{level} as level", f"stop / weight <= {level} as capped")
    ranked = ranked.selectExpr("*", "max(case when not capped then level end) over () as common")
    return ranked.selectExpr("source", "source_size",
                             "case when capped then cast(stop as double) else weight * common end as target")


def mix(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """``documents`` (doc_id, text, source, any other columns) with size, source_size, target and copies."""
    sized = documents.withColumn("size", n_words())
    # written, so that Spark knows its size and leaves the documents where they are unless it is large
    per_source = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap),
                         "mix-targets")
    per_source = per_source.select(F.col("source").alias("__source"), "source_size", "target")
    taken = [c for c in ("source_size", "target", "copies") if c in documents.columns]
    out = sized.drop(*taken).join(per_source, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")),
                              1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    return out.withColumn("copies", (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each row as often as its copies say."""
    return (mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .drop("copies"))


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
