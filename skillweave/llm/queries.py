"""Registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.llm import (decontaminate, hamming_search, hard_negatives, line_dedup, line_quality, mixing, packing,
                            quotations, shared_search, simhash, token_counts, toxicity, warc)
from skillweave.llm.common import table, written
from skillweave.llm.oracle import ORACLE


def op1_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link(written(quotations.as_mail(table(spark, sf_dir, "conversations")), "mail"))


def op4_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    field = line_quality.trained(documents, table(spark, sf_dir, "labels"))
    return line_quality.score(documents, field).select("doc_id", toxicity.held_out(3, 1).alias("held_out"), "score",
                                                       "predicted")


def op5_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.trained(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model).select("doc_id", toxicity.held_out(5, 0).alias("held_out"), "score", "predicted")


def op6_cuckoo_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return line_dedup.digest(line_dedup.LineDedupState.of(documents).clean(documents))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents")))


def op8_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % hamming_search.QUERY_MODULUS == 0)


def op9_merged_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op11_shared_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op13_slot_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hard_negatives.relabelled(table(spark, sf_dir, "embeddings"))
    return hard_negatives.mine(vectors, F.col("vec_id") % hard_negatives.ANCHOR_MODULUS == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_winnowing_decontamination, op2_arc_to_warc, op3_quotation_linking, op4_line_crf_quality,
                            op5_ftrl_toxicity, op6_cuckoo_line_dedup, op7_source_mixing,
                            op8_multi_index_hashing, op9_merged_token_counts, op10_pivot_simhash,
                            op11_shared_term_search, op12_shortest_pack_first, op13_slot_hard_negatives, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
