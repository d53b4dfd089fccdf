"""End-to-end run: every sink written once from one DataFrame graph, restartable stage by stage.

Spans and mappings feed several sinks, so they are written once as Parquet
under the run folder and read back: this both cuts the lineage (a lost
executor recomputes from the written table, not from the raw text) and keeps
the sinks from recomputing the extraction. The run folder lives under the
shared ``spark.checkpoint.dir`` unless the caller names one.

Each stage leaves a note under ``_stages`` when it is whole: the digest of what
the run reads (input files, parameters, models) and the counts observed while
it was written. A run over the same folder takes up after the last whole stage
as long as the digest is the same; with any other digest it starts anew. The
texts are read by the first stage only, so a later stage that failed is
repeated without a scan.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skillweave import __version__
from skillweave.operators import counters, rdf
from skillweave.plans.flow import Flow
from skillweave.session import get_text, hadoop_path, put_text, scratch_path
from skillweave.sources import sinks

TABLES = ("spans", "text_counts", "mappings", "requirements", "stage_counts", "triples")
SINKS = ("mappings_csv", "ntriples", "turtle")


def input_digest(flow: Flow, *more: object) -> str:
    """Names what a run reads: of files their folders' size, number of files and time of change, of a table in memory
    its plan; with the parameters and the models' names."""
    parts: list = [__version__, repr(flow.config), flow.models(), flow.tagger_sizes, flow.tagger_models, *map(str, more)]
    for df in (flow.postings, flow.concepts, flow.dictionary):
        files = sorted(df.inputFiles())
        parts.append(hashlib.sha256("\n".join(files).encode()).hexdigest() if files else df.semanticHash())
        parts += [_folder(df.sparkSession, f) for f in sorted({f.rpartition("/")[0] for f in files})]
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def _folder(spark: SparkSession, path: str) -> list:
    fs, p = hadoop_path(spark, path)
    held = fs.getContentSummary(p)
    return [path, held.getLength(), held.getFileCount(), fs.getFileStatus(p).getModificationTime()]


class Stages:
    """The notes of whole stages under a run folder."""

    def __init__(self, spark: SparkSession, out: str, digest: str) -> None:
        self.spark, self.out, self.digest, self.ran = spark, out, digest, []
        self.valid = True  # until a stage runs, later notes may count as well

    def note(self, name: str) -> dict | None:
        """The counts of a stage that is whole, written from the same input after whole stages only."""
        text = get_text(self.spark, f"{self.out}/_stages/{name}") if self.valid else None
        note = json.loads(text) if text is not None else {}
        return note["counts"] if note.get("digest") == self.digest else None

    def once(self, name: str, write) -> dict:
        """Runs ``write`` unless the stage is whole; the counts it returned then or now."""
        counts = self.note(name)
        if counts is None:
            self.valid = False
            counts = write() or {}
            self.ran.append(name)
            put_text(self.spark, f"{self.out}/_stages/{name}", json.dumps({"digest": self.digest, "counts": counts}))
        return counts


def _sums(sums: dict) -> list:
    return [F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()]]


def _write_observed(df: DataFrame, path: str, sums: dict) -> dict:
    """Writes a table and observes its number of rows and ``sums`` on the way."""
    seen = Observation()
    df.observe(seen, *_sums(sums)).write.mode("overwrite").parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


def run(spark: SparkSession, flow: Flow, out_dir: str | None = None, input_desc: str = "postings",
        per_posting: bool = False, concepts_desc: str = "concepts") -> dict[str, str]:
    """Writes all sinks; returns their folders. With ``per_posting`` the review CSV and the Turtle documents are one
    file per advert, named after its id (opt-in: so many files hurt any distributed file system). A second run with the
    same ``out_dir`` and input does only what the first one left."""
    out = (out_dir or scratch_path(spark, "run")).rstrip("/")
    paths = {k: f"{out}/{k}" for k in (*TABLES, *SINKS, "files", "run_metadata")}
    stages = Stages(spark, out, input_digest(flow, per_posting, input_desc, concepts_desc))
    counts: dict[str, int] = {}

    sums = {"text_counts": {"n_tokens": "n_tokens", "n_sentences": "n_sentences"},
            "mappings": {"n_accepted": (F.col("decision") == "accepted").cast("long")}}

    def noted(name: str, got: dict) -> None:
        counts.update({k: v for k, v in got.items() if k != "rows"} | {f"{name}_rows": got["rows"]})

    def table(name: str, make) -> DataFrame:
        noted(name, stages.once(name, lambda: _write_observed(make(), paths[name], sums.get(name, {}))))
        return spark.read.parquet(paths[name])

    for name, make in (("spans", lambda: flow.spans), ("text_counts", lambda: counters.text_counts(flow)),
                       ("mappings", lambda: flow.mappings), ("requirements", lambda: flow.requirements)):
        read = table(name, make)
        if name != "text_counts":
            flow.__dict__[name] = read  # what follows reads the written table
    flow.release(flow.facts)
    texts = spark.read.parquet(paths["text_counts"])
    table("stage_counts", lambda: counters.stage_counts(flow, texts))
    stages.once("mappings_csv", lambda: _csv(spark, flow, paths["mappings_csv"], per_posting))
    triples = table("triples", lambda: rdf.triples(flow.facts, flow.requirements, flow.config))
    stages.once("ntriples", lambda: {} if sinks.write_text(rdf.n_triples(triples), paths["ntriples"]) else {})
    stages.once("turtle", lambda: _turtle(spark, flow, paths["turtle"], per_posting))

    def metadata() -> dict:
        files = sinks.written_files(spark, {k: paths[k] for k in (*TABLES, *SINKS)}, TABLES)
        files.write.mode("overwrite").parquet(paths["files"])
        files = spark.read.parquet(paths["files"])
        for sink, n in files.where("rows is not null").groupBy("sink").agg(F.sum("rows")).collect():
            if n != counts[f"{sink}_rows"]:  # tasks that ran twice after a loss were seen twice: count what was written
                stored = spark.read.parquet(paths[sink]).agg(*_sums(sums.get(sink, {}))).first().asDict()
                noted(sink, {k: int(v) for k, v in stored.items()})
        outputs = files.where(F.col("sink").isin(*SINKS))
        said = {"posting_count": counts["text_counts_rows"], "n_tokens": counts["n_tokens"], "n_sentences": counts["n_sentences"],
                "n_spans": counts["spans_rows"], "n_mappings": counts["mappings_rows"], "n_accepted": counts["n_accepted"],
                "n_requirements": counts["requirements_rows"], "n_triples": counts["triples_rows"]}
        sinks.write_json(sinks.run_metadata(flow.facts, input_desc, outputs, flow.config, flow.models(), concepts_desc,
                                            said), paths["run_metadata"])
        return said
    stages.once("run_metadata", metadata)
    flow.release()
    return paths


def _csv(spark: SparkSession, flow: Flow, path: str, per_posting: bool) -> dict:
    sinks.write_mapping_csv(sinks.mapping_review(flow.mappings, flow.spans), path, per_posting)
    if per_posting:
        sinks.name_per_posting(spark, path, "_mappings.csv")
    return {}


def _turtle(spark: SparkSession, flow: Flow, path: str, per_posting: bool) -> dict:
    documents = rdf.turtle_documents(flow.facts, flow.requirements, flow.config)
    sinks.write_text(documents, path, col="turtle", partition_col="posting_id" if per_posting else None)
    if per_posting:
        sinks.name_per_posting(spark, path, ".ttl")
    return {}
