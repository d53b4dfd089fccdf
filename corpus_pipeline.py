"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination and mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. Each works on every row its predecessor kept; all but the last return the columns of ``documents``.

Defined results: extra columns pass through with their values, whatever their names; what the last stage adds (size,
source_size, target, copy) takes the place of columns of that name, which are then called given_size and so on. A table
without n_chars has none after either. Null, empty and very long texts follow the operators (see their modules); where
rows share a doc_id but not a text each row is decided by its own text. Near-dedup keeps one row of each group of near
copies, with or without doc_ids; of rows that differ in other columns only, the first by a hash of the whole row. An empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillweave.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from skillweave.llm.common import split_rows, table, without, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (trained on what is left of the labelled ones) rejects go."""
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return without(docs, toxicity.score(docs, model).where("predicted = 1"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in several documents stay in one of them; n_chars follows a changed text."""
    given = {c: f"__given_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    held = docs.withColumnsRenamed(given)
    cleaned = line_dedup.LineDedupState.of(held).clean(held)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*[F.col(f"`{given.get(c, c)}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: the smallest doc_id (none comes last), then the text first by
    hash, and of rows equal in both one."""
    found = written(simhash.near_duplicates(docs), "near-duplicates")
    rows = found.groupBy("root", "doc_id", "row_key").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "n")).alias("k")
    keeps = written(rows.groupBy("root").agg(first).select(F.col("k.doc_id").alias("k_id"), F.col("k.row_key").alias("k_key"),
                                                           F.col("k.n").alias("n")), "near-duplicate-keeps")
    kept = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("row_key") == F.col("k_key"))
    out = without(docs, found.join(keeps, kept, "left_anti"))
    repeated = written(keeps.where("n > 1").select(F.col("k_id").alias("doc_id"), F.col("k_key").alias("row_key")), "repeated")
    if repeated.isEmpty():
        return out
    once, several = split_rows(out, repeated)
    # of rows equal in both the first by a hash of the whole row, so that reruns keep the same one
    by_row = Window.partitionBy("doc_id", F.xxhash64("text"), "text").orderBy("__row")
    first = several.withColumn("__row", _row_hash(docs)).withColumn("__nth", F.row_number().over(by_row)).where("__nth = 1")
    return once.unionByName(first.drop("__row", "__nth"))


def _row_hash(docs: DataFrame):
    """A hash of all of a row; of a map as its text, as Spark hashes no maps."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("n_hit > 0"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks, with size, source_size, target and the number of the copy."""
    given = {c: f"given_{c}" for c in ("size", "source_size", "target", "copies", "copy") if c in docs.columns}
    return mixing.emit(mixing.mix(docs.withColumnsRenamed(given)))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

#: Neither the trained model of the first stage nor the 64-bit hash of the third can be stated in DuckDB's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
