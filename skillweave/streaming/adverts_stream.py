"""Structured Streaming front end: adverts arriving as JSON files.

The flow has no cross-advert state: every operator is keyed by the advert, so a micro-batch is just a small batch.
``foreachBatch`` checks each batch, runs the whole flow on its valid adverts and writes requirements, mappings and the
rejected rows with their reasons. Each epoch overwrites its own partition, so a replayed batch leaves the same rows.
The checkpoint folder of the stream lives under the shared ``spark.checkpoint.dir``, so a restarted query resumes
after the last committed batch.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from skillweave.config import DEFAULT, Config
from skillweave.plans.flow import Flow
from skillweave.session import ensure_checkpoint_dir
from skillweave.sources.adverts import accepted, parsed, rejected


def advert_stream(spark: SparkSession, in_dir: str, max_files: int = 100) -> DataFrame:
    """Streaming DataFrame of all lines of the JSON-lines files in ``in_dir``, as ``read_raw`` gives them."""
    return parsed(spark.readStream.option("maxFilesPerTrigger", max_files).text(in_dir))


def write_epoch(df: DataFrame, epoch: int, out_dir: str, concepts: DataFrame, dictionary: DataFrame,
                tagger_sizes: list[tuple[str, int]], tagger_models: list[str], config: Config = DEFAULT, **slots) -> None:
    """One micro-batch; running it again replaces what it wrote."""
    raw = df.persist(StorageLevel.MEMORY_AND_DISK)
    flow = Flow(postings=accepted(raw), concepts=concepts, dictionary=dictionary, tagger_sizes=tagger_sizes,
                tagger_models=tagger_models, config=config, **slots)
    for name, rows in (("requirements", lambda: flow.requirements), ("mappings", lambda: flow.mappings),
                       ("rejects", lambda: rejected(raw))):
        rows().write.mode("overwrite").parquet(f"{out_dir}/{name}/epoch={epoch}")
    flow.release()
    raw.unpersist()


def start(spark: SparkSession, in_dir: str, out_dir: str, concepts: DataFrame, dictionary: DataFrame,
          tagger_sizes: list[tuple[str, int]], tagger_models: list[str], config: Config = DEFAULT,
          trigger_once: bool = False, checkpoint_location: str | None = None, **slots):
    """Start the streaming query; returns the StreamingQuery.

    The default checkpoint is named after the input folder, so restarting the same stream resumes where it stopped.
    ``slots`` are the model slots of ``Flow``."""
    import hashlib
    tag = hashlib.sha1(in_dir.encode("utf-8")).hexdigest()[:12]
    ckpt = checkpoint_location or f"{ensure_checkpoint_dir(spark).rstrip('/')}/advert-stream-{tag}"

    def batch(df: DataFrame, epoch: int) -> None:
        if not df.isEmpty():
            write_epoch(df, epoch, out_dir, concepts, dictionary, tagger_sizes, tagger_models, config, **slots)

    w = advert_stream(spark, in_dir).writeStream.foreachBatch(batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
