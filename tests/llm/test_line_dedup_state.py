"""Incremental line dedup: shards that follow the keys, layers of counts, full shards that come back."""

import numpy as np
from pyspark.sql import functions as F

from skillweave.llm import common, line_dedup
from skillweave.llm.common import table
from tests.llm import brute
from tests.llm.conftest import SMALL


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def cleaned(state, docs):
    return sorted(map(tuple, line_dedup.digest(state.clean(docs)).collect()), key=repr)


def expected(docs):
    return sorted(brute.line_dedup([(r.doc_id, r.text) for r in docs.collect()]), key=repr)


def test_shards_follow_the_number_of_keys(spark, monkeypatch):
    assert [line_dedup.shard_count(n) for n in (0, 1, 90_000, 90_001, 200_000, 10**9)] == [1, 1, 1, 2, 4, 512]
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)  # far past the capacity that one shard is meant for
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    first, more = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    state = line_dedup.LineDedupState.of(first)
    small = state.filters.count()
    assert small > 1 and cleaned(state, first) == expected(first)
    grown = state.add(more)
    assert grown.filters.count() > small and cleaned(grown, docs) == expected(docs)
    assert cleaned(grown.delete(more), first) == expected(first)


def test_many_changes_make_layers_that_are_merged(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LAYERS", 2)
    line = "a line that is long enough to count {}"
    docs = spark.createDataFrame([(i, "\n".join(line.format(j) for j in range(i % 3 + 1)), i) for i in range(12)],
                                 "doc_id long, text string, n_lines long")
    state = line_dedup.LineDedupState.of(docs.where("doc_id < 4"))
    for i in range(4, 8):
        state = state.add(docs.where(F.col("doc_id") == i))
        assert len(state.layers) <= 2
        now = docs.where(F.col("doc_id") <= i)
        assert cleaned(state, now) == expected(now)
        assert rows(state.counts, "key", "n_docs", "max_doc") == rows(
            line_dedup.reference_counts(line_dedup.postings(now)), "key", "n_docs", "max_doc")
    for i in (7, 6, 2, 99):  # the largest first, and one that was never there
        state = state.delete(docs.where(F.col("doc_id") == i))
    left = docs.where("doc_id in (0, 1, 3, 4, 5)")
    assert cleaned(state, left) == expected(left)
    # a caller's column of the same name is left out for the operator's
    assert {r.n_lines for r in state.clean(left).collect()} <= {1, 2, 3}


def test_a_full_shard_comes_back_when_its_keys_fit(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    state = line_dedup.LineDedupState.of(docs)
    state.filters = state.filters.withColumn("full", F.lit(True)).withColumn("cells", F.lit(b""))
    state.filters = common.written(state.filters.withColumn("cells", F.lit(bytes(line_dedup.BUCKETS * line_dedup.SLOTS * 2))), "full")
    after = state.delete(docs.where("doc_id = 0"))
    left = docs.where("doc_id <> 0")
    assert not after.filters.where("full").count() and cleaned(after, left) == expected(left)
    filled = sum(int((np.frombuffer(bytes(r.cells), np.uint16) > 0).sum()) for r in after.filters.collect())
    assert filled == after.counts.where("n_docs >= 3").count()


def test_the_bitmap_grows_with_its_keys(spark):
    assert common.bitmap_bits(0) == common.bitmap_bits(1000) == 16
    assert common.bitmap_bits(2**21) == 26 and common.bitmap_bits(10**12) == 29
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    keys = common.written(docs.where("doc_id % 4 = 0").select("doc_id", F.xxhash64("text").alias("row_key")), "keys")
    sure, perhaps = common.split_rows(docs, keys)
    assert sure.count() + perhaps.count() == 20_000
    assert sure.where("doc_id % 4 = 0").count() == 0 and perhaps.count() < 5_000 + 0.1 * 15_000
