"""Sweeps in segments give what one run over the whole advert gives."""

import random

import pytest

from skillweave.operators import compare, extract

SPANS = "posting_id string, id string, extractor string, char_start long, char_end long, text string, span_type string"


def random_spans(seed):
    rnd, rows = random.Random(seed), []
    for p in ("a", "b", "c"):
        for i in range(120):
            start = rnd.randrange(3_000)
            rows.append((p, f"{p}{i}", rnd.choice(["adj_noun", "tagger"]), start, start + rnd.choice([1, 5, 40, 700]), "", "skill"))
    return rows


@pytest.mark.parametrize("bins", [100, 1 << 16])
def test_overlap_in_bins_of_100_characters(spark, bins):
    rows = random_spans(bins)
    got = {r.id: r.overlaps for r in compare.extractor_overlap(spark.createDataFrame(rows, SPANS), "adj_noun", "tagger", bins).collect()}
    want = {a[1]: any(b[0] == a[0] and b[2] != a[2] and a[3] < b[4] and b[3] < a[4] for b in rows) for a in rows}
    assert got == want and len(set(want.values())) == 2


@pytest.mark.parametrize("bins", [100, 1 << 16])
def test_kinds_in_bins_of_100_characters(spark, bins):
    rnd, sentences, at = random.Random(2), [], 0
    while at < 3_000:
        n = rnd.choice([3, 50, 400, 900])
        sentences.append(("a", at, at + n))
        at += n
    marked = [s for s in sentences if rnd.random() < 0.4]
    spans = [r for r in random_spans(1) if r[0] != "c"]
    got = {r.id: r.requirement_kind for r in extract.kinds_by_marked(
        spark.createDataFrame(spans, SPANS), spark.createDataFrame(marked, "posting_id string, char_start long, char_end long"),
        bins).collect()}
    want = {s[1]: "nice_to_have" if any(m[0] == s[0] and m[1] <= s[3] < m[2] for m in marked) else "must" for s in spans}
    assert got == want and len(set(want.values())) == 2


def test_one_long_advert_is_many_tasks(spark):
    """No window of the sweep takes an advert's spans whole: only one row for each bin meets in one task."""
    spans = spark.createDataFrame(random_spans(3), SPANS)
    plan = compare.extractor_overlap(spans, "adj_noun", "tagger", 100)._jdf.queryExecution().optimizedPlan().toString()
    wide = [x for x in plan.splitlines() if "windowspecdefinition(posting_id" in x]
    assert wide and all("windowspecdefinition(posting_id" in x and ("bin_" in x) for x in wide)
