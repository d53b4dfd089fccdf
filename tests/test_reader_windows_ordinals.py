"""A text model read once for tokens and sentences, a tagger in windows, ordinals found range by range."""

import random

import pandas as pd
import pytest

from skillweave.operators import annotate, ordinals, reader, tagger
from skillweave.plans import bindings as B
from skillweave.plans import registry

TEXT = "string, raw_text string"


def test_the_models_sentences_decide_the_kind(spark):
    kinds = lambda name: {(r.posting_id, r.id): r.requirement_kind for r in registry.QUERIES[name](spark, "/root/testdata/sf0.01").collect()}
    own, rules = kinds("spans_by_reader"), kinds("spans")
    assert own.keys() == rules.keys()
    assert any(own[k] != rules[k] for k in own)


def test_a_reader_sees_each_text_once_and_yields_both(spark):
    seen = spark.sparkContext.accumulator(0)

    def load():
        def read(text):
            seen.add(1)
            return annotate._tokens(text), [(0, 3), (3, len(text))]
        return read
    post = spark.createDataFrame([("a", "ein guter Satz. Ende"), ("b", None), ("c", "abc def")], f"id {TEXT}")
    parts = reader.read_parts(post, load).persist()
    assert parts.count() == 5 + 2 + 2 + 2 and seen.value == 2
    assert [(r.text, r.char_start, r.char_end) for r in reader.sentences_of(parts).where("posting_id = 'c'").orderBy("sent_ord").collect()] \
        == [("abc", 0, 3), (" def", 3, 7)]
    assert [r.text for r in reader.tokens_of(parts).where("posting_id = 'a'").orderBy("i").collect()] == ["ein", "guter", "Satz", ".", "Ende"]
    parts.unpersist()


def test_spots_are_what_the_spans_need_and_no_more(spark):
    """The rows of the whole reading, sorted out after it, give the same pairs and marker sentences; ids may repeat."""
    from pyspark.sql import functions as F

    from skillweave.functions.text import has_marker
    from skillweave.operators import extract
    texts = ["gute freundliche Leitung der Station.\nNICHT ruhig\nauch", None, "", "ein Satz, sportlich und ruhige Bildung nicht",
             "gute freundliche Leitung der Station.\nNICHT ruhig\nauch", "Zeitung"]
    post = spark.createDataFrame([(f"p{i % 4}", t) for i, t in enumerate(texts)], f"id {TEXT}")
    parts, spots = reader.read_parts(post, B.line_reader), reader.read_spots(post, B.line_reader, B.TEST_MARKERS)
    pairs = lambda tokens: sorted(tuple(r) for r in extract.adj_noun_spans(tokens, post, key="id").select(
        "id", "char_start", "char_end", "text").collect())
    assert pairs(reader.tokens_of(spots)) == pairs(reader.tokens_of(parts)) != []
    marked = lambda s: sorted(tuple(r) for r in s.select("posting_id", "char_start", "char_end").collect())
    assert marked(spots.where("part = 'sentence'")) == marked(reader.sentences_of(parts).where(has_marker("text", B.TEST_MARKERS))) != []
    assert spots.where(F.col("pos") == "X").count() == 0 and "text" not in spots.columns


@pytest.mark.parametrize("size, context", [(5, 2), (7, 2), (50, 2), (9, 4)])
def test_windows_give_the_hits_of_the_whole_text(spark, size, context):
    rnd = random.Random(size)
    word = lambda: rnd.choice(["Bildung,", "Station", "der", "x", "Ä.", "\n", "  und", "Haus"])
    rows = [(f"p{i}", " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 3, 4, 5, 6, 11, 200, 1_301])]
    rows += [("n", None), ("s", " \n "), ("one", "Station" * 900)]
    post = spark.createDataFrame(rows, f"posting_id {TEXT}")
    got = sorted(map(tuple, tagger.windowed_slot(post, B.noun_tagger, size, context).collect()))
    whole = B.noun_tagger(pd.DataFrame(rows, columns=["posting_id", "raw_text"]))
    want = sorted(whole[tagger.HIT_COLUMNS].itertuples(index=False, name=None))
    assert got == want and len(set(got)) == len(got) > 500


def test_windows_are_bounded_and_own_every_character():
    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choice("ab  \n") for _ in range(rnd.randrange(60)))
        windows = tagger.text_windows(text, 7, 2)
        assert all(len(annotate.WORD.findall(text[a:b])) <= 7 for _, a, b, _, _ in windows)
        at = 0
        for _, _, _, low, high in windows:
            assert low == at
            at = high
        assert at == (len(text) if windows else 0)
    with pytest.raises(ValueError):
        tagger.windowed_slot(None, None, 4, 2)


def test_ordinals_of_many_ranges(spark):
    rnd = random.Random(1)
    names = [f"u{rnd.randrange(5_000):05d}" for _ in range(3_000)] + [None, "u", "ü"]
    rows = [(n, i) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "uri string, x long").repartition(6)
    got = [(r.uri, r.x) for r in sorted(ordinals.with_ordinals(df, "uri").collect(), key=lambda r: r.ord)]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    assert sorted(r.ord for r in ordinals.with_ordinals(df, "uri").collect()) == list(range(1, len(rows) + 1))
    assert ordinals.with_ordinals(df.limit(0), "uri").count() == 0


def test_concepts_are_numbered_without_a_window_over_all(spark, fix):
    from skillweave.sources.concepts import read_concepts
    plan = read_concepts(spark, fix("concepts_small.json"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan
