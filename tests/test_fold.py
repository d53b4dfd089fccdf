"""The fold by segment summaries equals the fold row by row."""

import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillweave.operators import fold, requirements

ROWS = "posting_id string, span_ord long, id string, concept_uri string, mapping_score double, requirement_kind string"


def sequential(rows):
    out = {}
    for p, o, i, c, s, k in sorted(rows, key=lambda r: r[1]):
        cur = out.get((p, c))
        if cur is None:
            out[p, c] = (o, s, k, i)
        elif s > cur[1] or (cur[2] == "nice_to_have" and k == "must"):
            out[p, c] = (cur[0], s, k, i)
    return out


def random_rows(seed, n, groups):
    rnd = random.Random(seed)
    ords = rnd.sample(range(5 * n), n)
    return [(f"p{rnd.randrange(groups)}", o, f"s{o}", f"c{rnd.randrange(2)}", rnd.choice([0.1, 0.2, 0.3, 0.4, 0.5]),
             rnd.choice(["must", "nice_to_have", "nice_to_have"])) for o in ords]


@pytest.mark.parametrize("chunk", [1, 3, 50, 4096])
def test_equal_to_the_sequential_fold_on_random_rows(spark, chunk):
    rows = random_rows(chunk, 3_000, 9) + [("one", 1, "x", "c", 0.5, "must")]
    df = spark.createDataFrame(rows, ROWS).repartition(7)
    got = {(r.posting_id, r.concept_uri): (r.first_ord, r.score, "must" if r.must else "nice_to_have", r.id)
           for r in fold.ordered_fold(df, ["posting_id", "concept_uri"], "span_ord", "mapping_score",
                                      F.col("requirement_kind") == "must", "id", chunk).collect()}
    assert got == sequential(rows)


def test_batches_of_two_rows_carry_the_open_group(spark):
    rows = random_rows(8, 200, 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        df = spark.createDataFrame(rows, ROWS)
        got = {(r.posting_id, r.concept_uri): r.id for r in fold.ordered_fold(
            df, ["posting_id", "concept_uri"], "span_ord", "mapping_score", F.col("requirement_kind") == "must", "id", 7).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: v[3] for k, v in sequential(rows).items()}


def test_batches_whose_columns_are_declared_free_of_nulls(spark):
    rows = random_rows(9, 300, 2)
    kind = F.when(F.col("requirement_kind") == "must", "must").otherwise("nice_to_have")  # as the flow makes it
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        df = spark.createDataFrame(rows, ROWS).withColumn("requirement_kind", kind)
        assert not df.schema["requirement_kind"].nullable
        got = {(r.posting_id, r.concept_uri): r.id for r in fold.ordered_fold(
            df, ["posting_id", "concept_uri"], "span_ord", "mapping_score", F.col("requirement_kind") == "must", "id", 7).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: v[3] for k, v in sequential(rows).items()}


def test_merging_is_associative():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(2, 12))
        score, must = rng.choice([0.1, 0.2, 0.3], n), rng.random(n) < 0.4
        score2, must2 = np.concatenate([score, score]), np.concatenate([must, must])
        leaf = (score.copy(), np.arange(n), np.where(must, np.arange(n), -1))
        whole = fold.merged(np.zeros(n, int), *leaf, score2, must2)
        cut = int(rng.integers(1, n))
        parts = fold.merged(np.array([0] * cut + [1] * (n - cut)), *leaf, score2, must2)
        again = fold.merged(np.zeros(2, int), *parts[1:], score2, must2)
        assert [x.tolist() for x in whole[1:]] == [x.tolist() for x in again[1:]]


def test_no_list_of_a_group_and_an_empty_input(spark):
    assert "collect_list" not in pathlib.Path(requirements.__file__).read_text(encoding="utf-8")
    none = spark.createDataFrame([], ROWS)
    post = spark.createDataFrame([("p", 3)], "id string, isco_group int")
    assert requirements.consolidate(none, post, {}, "DQR4").count() == 0
