"""Sinks: mapping review CSV, RDF text, run metadata.

Default output is sharded (hash-partitioned by posting, sorted within each
file); one file per advert is opt-in (``per_posting=True``), because millions
of tiny files hurt any distributed file system.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillweave import __version__
from skillweave.config import Config
from skillweave.functions.fmt import fixed

REVIEW_SCHEMA = T.StructType([
    T.StructField("posting_id", T.StringType()), T.StructField("span_id", T.StringType()),
    T.StructField("span_text", T.StringType()), T.StructField("extractor", T.StringType()),
    T.StructField("rank", T.IntegerType()), T.StructField("concept_uri", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("decision", T.StringType()),
])
_CSV = {"header": "true", "escape": '"', "multiLine": "true",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def mapping_review(mappings: DataFrame, spans: DataFrame) -> DataFrame:
    """All mappings (every rank) with span text and extractor; blanks for unknown spans."""
    s = spans.select(F.col("id").alias("span_id"), F.col("text").alias("span_text"), "extractor")
    j = mappings.join(s, "span_id", "left")
    return j.select("posting_id", "span_id", F.coalesce("span_text", F.lit("")).alias("span_text"),
                    F.coalesce("extractor", F.lit("")).alias("extractor"), "rank", "concept_uri",
                    fixed("score", 4).alias("score"), "decision")


def write_mapping_csv(review: DataFrame, path: str, per_posting: bool = False) -> str:
    """Rows ordered by (span_id as string, rank) within each posting."""
    if per_posting:  # the folder takes one copy of the id, the file keeps its own column
        review = review.withColumn("of", F.col("posting_id"))
        ordered = review.repartition("of").sortWithinPartitions("of", "span_id", "rank")
        ordered.write.mode("overwrite").options(**_CSV).partitionBy("of").csv(path)
        return path
    ordered = review.repartition("posting_id").sortWithinPartitions("posting_id", "span_id", "rank")
    ordered.write.mode("overwrite").options(**_CSV).csv(path)
    return path


def name_per_posting(spark: SparkSession, path: str, ending: str) -> list[str]:
    """Moves the one file of each ``key=id`` folder under ``path`` to ``path/id + ending``; the new paths, sorted."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs, out = root.getFileSystem(conf), []
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if folder.isDirectory() and "=" in name:
            value = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name.partition("=")[2])
            target = jvm.org.apache.hadoop.fs.Path(root, value.replace("/", "_") + ending)
            for file in fs.listStatus(folder.getPath()):
                if file.getPath().getName().startswith("part-"):
                    fs.rename(file.getPath(), target)
            fs.delete(folder.getPath(), True)
            out.append(target.toString())
    return sorted(out)


def read_mapping_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REVIEW_SCHEMA).options(**_CSV).csv(path)


def write_text(lines: DataFrame, path: str, col: str = "line", partition_col: str | None = None) -> str:
    """A text sink (N-Triples lines, Turtle documents), sharded by default."""
    out = lines.select(partition_col, col) if partition_col else lines.select(col)
    w = out.write.mode("overwrite")
    (w.partitionBy(partition_col) if partition_col else w).text(path)
    return path


def written_files(spark: SparkSession, sinks: dict[str, str], tables: tuple[str, ...]) -> DataFrame:
    """(sink, file, bytes, rows) of the files under the folders of ``sinks``; rows, from the files' footers, of those that
    are Parquet ``tables``. No content is read."""
    listed, counted = None, None
    for name, path in sinks.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        part = files.select(F.lit(name).alias("sink"), F.col("path").alias("file"), F.col("length").alias("bytes"))
        listed = part if listed is None else listed.unionByName(part)
        if name in tables:
            rows = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
            counted = rows if counted is None else counted.unionByName(rows)
    name_of = lambda c: F.regexp_replace(c, "^file:/+", "/")
    listed = listed.withColumn("file", name_of("file"))
    if counted is None:
        return listed.withColumn("rows", F.lit(None).cast("long"))
    return listed.join(counted.withColumn("file", name_of("file")), "file", "left").select("sink", "file", "bytes", "rows")


def run_metadata(postings: DataFrame, input_desc: str, outputs: list[str] | DataFrame, cfg: Config, models: dict,
                 concepts_desc: str = "concepts", counts: dict[str, int] | None = None) -> DataFrame:
    """One row: time (UTC), version, input, advert count, output files, parameters (JSON) with the models that ran; with
    the ``counts`` of a run (its adverts and stages) these, and the adverts are not counted again. ``outputs`` are names
    or a table of files (file)."""
    params = json.dumps({
        **models,
        "concepts": concepts_desc,
        "mapping_threshold": cfg.threshold,
        "mapping_top_k": cfg.top_k,
        "level_strategy": f"ISCO major group default (fallback {cfg.fallback_level})",
    }, ensure_ascii=False, sort_keys=True)
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    if isinstance(outputs, DataFrame):
        files = outputs.agg(F.sort_array(F.collect_list("file"))).scalar()  # names of files, not rows
    else:
        files = F.array(*[F.lit(o) for o in outputs]).cast("array<string>")
    if counts is None:
        base, known = postings.agg(F.count(F.lit(1)).alias("posting_count")), [F.col("posting_count")]
    else:
        base = postings.sparkSession.range(1)
        known = [F.lit(n).cast("long").alias(name) for name, n in counts.items()]
    return base.select(
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("run_timestamp"),
        F.lit(__version__).alias("pipeline_version"),
        F.lit(input_desc).alias("input"),
        *known,
        files.alias("output_files"),
        F.lit(params).alias("parameters"),
    )


def write_json(df: DataFrame, path: str) -> str:
    df.coalesce(1).write.mode("overwrite").json(path)
    return path
