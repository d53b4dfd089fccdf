"""Operators on hand-made rows: merge, fold, matching ties, kinds, overlap."""

import random

from pyspark.sql import functions as F

from skillweave.operators import compare, extract, match, requirements, tagger

HIT = "posting_id string, model string, hit_ord long, word string, start long, end long, score double"


def _merged(spark, rows):
    out = tagger.merge_adjacent(tagger.strip_hits(spark.createDataFrame(rows, HIT)))
    return sorted((r.word, r.start, r.end, r.score) for r in out.collect())


def test_nested_hits_merge_with_previous_end(spark):
    rows = [("p", "skill", 0, "a", 0, 10, 1.0), ("p", "skill", 1, "b", 2, 4, 1.0), ("p", "skill", 2, "c", 6, 8, 1.0)]
    # [2,4) merges (gap <= 1 incl. nesting), end becomes 4; [6,8) has gap 2 -> new span
    assert _merged(spark, rows) == [("a b", 0, 4, 1.0), ("c", 6, 8, 1.0)]


def test_running_pairwise_average(spark):
    rows = [("p", "skill", i, w, s, s + 1, sc) for i, (w, s, sc) in enumerate([("x", 0, 1.0), ("y", 2, 0.5), ("z", 4, 0.5)])]
    assert _merged(spark, rows) == [("x y z", 0, 5, 0.625)]


def test_punctuation_only_dropped_and_end_moves(spark):
    rows = [("p", "skill", 0, ").", 0, 2, 0.9), ("p", "skill", 1, "Java,", 3, 8, 0.8)]
    assert _merged(spark, rows) == [("Java", 3, 7, 0.8)]


def _seq_merge(hits):
    hits = sorted(hits, key=lambda h: (h[1], h[0]))
    out = []
    for h in hits:
        if out and h[1] - out[-1][2] <= 1:
            p = out[-1]
            out[-1] = [p[0] + " " + h[3], p[1], h[2], (p[3] + h[4]) / 2]
        else:
            out.append([h[3], h[1], h[2], h[4]])
    return sorted(tuple(x) for x in out)


def test_merge_matches_sequential_fold_randomised(spark):
    rnd = random.Random(7)
    rows, expect = [], []
    for d in range(30):
        pos, hits = 0, []
        for i in range(rnd.randint(1, 12)):
            pos += rnd.randint(0, 3)
            ln = rnd.randint(1, 5)
            w = f"w{d}_{i}"
            hits.append((i, pos, pos + ln, w, round(rnd.random(), 3)))
            pos += rnd.choice([0, ln, ln + 1])
        rows += [(f"d{d}", "skill", h[0], h[3], h[1], h[2], h[4]) for h in hits]
        expect += [(f"d{d}",) + x for x in _seq_merge([(h[0], h[1], h[2], h[3], h[4]) for h in hits])]
    out = tagger.merge_adjacent(spark.createDataFrame(rows, HIT))
    got = sorted((r.posting_id, r.word, r.start, r.end, round(r.score, 9)) for r in out.collect())
    assert got == sorted((e[0], e[1], e[2], e[3], round(e[4], 9)) for e in expect)


ACC = "posting_id string, span_ord long, id string, concept_uri string, mapping_score double, requirement_kind string"


def _fold(spark, items):
    rows = [("p", i + 1, f"s{i + 1}", "c", sc, k) for i, (k, sc) in enumerate(items)]
    acc = spark.createDataFrame(rows, ACC)
    post = spark.createDataFrame([("p", 3)], "id string, isco_group int")
    r = requirements.consolidate(acc, post, {3: "DQR5"}, "DQR4").collect()
    assert len(r) == 1
    return r[0]


def test_fold_is_ordered_not_argmax(spark):
    r = _fold(spark, [("nice_to_have", 0.9), ("must", 0.6), ("nice_to_have", 0.7)])
    assert (r.requirement_kind, r.provenance_confidence) == ("nice_to_have", 0.7)
    r = _fold(spark, [("nice_to_have", 0.9), ("nice_to_have", 0.7), ("must", 0.6)])
    assert (r.requirement_kind, r.provenance_confidence) == ("must", 0.6)


def test_fold_equal_scores_keep_first(spark):
    r = _fold(spark, [("must", 0.8), ("must", 0.8)])
    assert r.span_id == "s1" and r.required_level == "DQR5"


def test_fold_randomised_against_python(spark):
    rnd = random.Random(3)
    rows, expect = [], {}
    for g in range(40):
        cur = None
        for i in range(rnd.randint(1, 8)):
            k = rnd.choice(["must", "nice_to_have"])
            sc = rnd.choice([0.5, 0.6, 0.7, 0.8, 0.9])
            rows.append((f"p{g % 5}", g * 100 + i, f"s{g}_{i}", f"c{g}", sc, k))
            if cur is None or sc > cur[1] or (cur[0] == "nice_to_have" and k == "must"):
                cur = (k, sc, f"s{g}_{i}")
        expect[f"c{g}"] = cur
    acc = spark.createDataFrame(rows, ACC)
    post = spark.createDataFrame([(f"p{i}", None) for i in range(5)], "id string, isco_group int")
    got = {r.refers_to_competence: (r.requirement_kind, r.provenance_confidence, r.span_id)
           for r in requirements.consolidate(acc, post, {}, "DQR4").collect()}
    assert got == expect


def test_sparse_top_k_index_smaller_than_k_and_ties(spark):
    q = spark.createDataFrame([("q", "abc")], "key string, text string")
    c = spark.createDataFrame([(2, "abc"), (1, "abc")], "ord long, pref_label string")
    got = [(r.rank, r.ord) for r in match.sparse_top_k(q, c, 3).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]  # two rows only; equal scores ordered by concept ordinal


def test_concepts_without_common_trigram_are_ranked(spark):
    q = spark.createDataFrame([("q", "SQL"), ("e", ""), ("n", None)], "key string, text string")
    c = spark.createDataFrame([(3, "Java"), (1, "Pflege"), (2, "SQL"), (4, "")], "ord long, pref_label string")
    got = {}
    for r in match.sparse_top_k(q, c, 3).collect():
        got.setdefault(r.key, []).append((r.rank, r.ord, round(r.score, 6)))
    assert {k: sorted(v) for k, v in got.items()} == {
        "q": [(1, 2, 1.0), (2, 1, 0.0), (3, 3, 0.0)], "e": [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)],
        "n": [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)]}
    assert match.sparse_top_k(q, c.limit(0), 3).count() == 0


def test_blocks_of_the_index_give_the_same_result(spark):
    rnd = random.Random(5)
    vec = lambda: [rnd.uniform(-1, 1) for _ in range(8)]
    same = vec()
    q = spark.createDataFrame([("m", i, vec()) for i in range(30)] + [("m", 30, same)], "model_id string, key long, vec array<double>")
    idx = spark.createDataFrame([("m", i, vec()) for i in range(50)] + [("m", 50 + i, same) for i in range(5)],
                                "model_id string, ord long, vec array<double>")
    norm = lambda df: sorted((r.key, r.rank, r.ord, r.score) for r in df.collect())
    whole, cut = norm(match.dense_top_k(q, idx, 3)), norm(match.dense_top_k(q, idx, 3, budget_bytes=8 * 8 * 7))
    assert whole == cut and len(whole) == 93
    assert [o for k, _, o, _ in whole if k == 30] == [50, 51, 52]
    texts = spark.createDataFrame([(str(i), f"text {i} of {i % 7}") for i in range(20)], "key string, text string")
    conc = spark.createDataFrame([(i, f"concept {i % 9} of text") for i in range(40)], "ord long, pref_label string")
    assert norm(match.sparse_top_k(texts, conc, 3)) == norm(match.sparse_top_k(texts, conc, 3, budget_bytes=20_000))


def test_score_matrix_is_bounded(monkeypatch):
    import numpy as np
    seen = []
    real = match.top_k_rows
    monkeypatch.setattr(match, "CHUNK_BYTES", 8 * 100 * 4)
    monkeypatch.setattr(match, "top_k_rows", lambda scores, *a: seen.append(scores.nbytes) or real(scores, *a))
    rng = np.random.default_rng(0)
    block = match.DenseBlock(np.arange(100), list(rng.normal(size=(100, 5))))
    got = [x for part in block.best(list(rng.normal(size=(50, 5))), 3) for x in part[0]]
    assert sorted(set(got)) == list(range(50)) and len(got) == 150 and max(seen) <= 8 * 100 * 4 and len(seen) > 10
    grams = match.GramBlock(np.arange(100), [["abc", f"g{i}"] for i in range(100)])
    assert sum(len(part[0]) for part in grams.best([["abc"]] * 50, 3)) == 150 and max(seen) <= 8 * 100 * 4


def test_head_is_the_next_noun_of_the_sentence(spark):
    from skillweave.operators import annotate
    text = "ein freundlicher und a b c d e Leitung. Ruhig? Bildung\nsportlich\nZeitung freundlich gute Wohnung"
    post = spark.createDataFrame([("p", text), ("q", None), ("r", "")], "id string, raw_text string")
    toks = annotate.tokens(post, key="id").collect()
    heads = {t.text: next(x.text for x in toks if x.i == t.head_i) for t in toks if t.dep == "nk"}
    assert heads == {"freundlicher": "Leitung", "freundlich": "Wohnung"}
    import numpy as np
    scanned = annotate.scan(post, [], np.zeros(8, dtype=np.uint8), ["bildung"]).collect()
    assert [x.text for r in scanned for x in r.pairs] == ["freundlicher und a b c d e Leitung", "freundlich gute Wohnung"]
    assert [text[m.char_start:m.char_end] for r in scanned for m in r.marked] == [" Bildung\n"]
    by_join = extract.adj_noun_spans(annotate.tokens(post, key="id"), post, key="id").collect()
    assert [s.text for s in by_join] == ["freundlicher und a b c d e Leitung", "freundlich gute Wohnung"]


def test_decision_threshold_inclusive(spark):
    m = spark.createDataFrame([(1, 0.5), (1, 0.49), (2, 0.9)], "rank int, score double")
    assert [r.decision for r in match.decide(m, 0.5).collect()] == ["accepted", "rejected", "rejected"]


def test_kind_by_span_start_only(spark):
    spans = spark.createDataFrame([("p", "a", 5, 40), ("p", "b", 25, 30), ("p", "c", 19, 22)],
                                  "posting_id string, id string, char_start long, char_end long")
    sents = spark.createDataFrame([("p", 0, 0, 20, "Pflicht ist das."), ("p", 1, 20, 50, "Gern erwünscht.")],
                                  "posting_id string, sent_ord long, char_start long, char_end long, text string")
    got = {r.id: r.requirement_kind for r in extract.classify_kinds(spans, sents, ["erwünscht"]).collect()}
    assert got == {"a": "must", "b": "nice_to_have", "c": "must"}


def test_overlap_flags_match_pairwise(spark):
    rows = [("p", "r1", "adj_noun", 0, 5), ("p", "r2", "adj_noun", 10, 12), ("p", "t1", "tagger", 4, 8),
            ("p", "t2", "tagger", 12, 14), ("p", "r3", "adj_noun", 20, 30), ("p", "t3", "tagger", 22, 23)]
    df = spark.createDataFrame(rows, "posting_id string, id string, extractor string, char_start long, char_end long")
    df = df.withColumn("text", F.lit("")).withColumn("span_type", F.lit("skill"))
    got = {r.id: r.overlaps for r in compare.extractor_overlap(df, "adj_noun", "tagger").collect()}
    want = {}
    for a in rows:
        want[a[1]] = any(a[3] < b[4] and b[3] < a[4] for b in rows if b[2] != a[2])
    assert got == want


def test_dense_exclude_self_against_brute_force(spark):
    import numpy as np
    rnd = np.random.default_rng(11)
    m = rnd.normal(size=(40, 6))
    m[5] = m[4]  # duplicate vectors: ties broken by ordinal
    rows = [("m", i, m[i].tolist()) for i in range(40)]
    q = spark.createDataFrame(rows, "model_id string, key long, vec array<double>")
    idx = q.withColumnRenamed("key", "ord")
    for budget in (64 << 20, 8 * 6 * 9):
        got = sorted((r.key, r.rank, r.ord) for r in
                     match.dense_top_k(q, idx, 3, budget_bytes=budget, exclude_self=True).collect())
        want = []
        for i in range(40):
            sc = m @ m[i]
            order = sorted((j for j in range(40) if j != i), key=lambda j: (-sc[j], j))[:3]
            want += [(i, r + 1, j) for r, j in enumerate(order)]
        assert got == sorted(want)


def test_words_of_a_text_are_those_of_the_pattern():
    """Split and placed without a match object for each word; blanks that only Python takes for such belong to words."""
    from skillweave.operators import annotate
    rnd = random.Random(4)
    parts = ["gute", "Ä.", "\U0001d518x", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028",
             "\u202f", "\u205f", "\u3000", "\u200b"]
    assert all(annotate.OTHER_BLANK.match(chr(c)) or chr(c) in " \t\n\x0b\x0c\r" for c in range(0x110000) if chr(c).isspace())
    for _ in range(2_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(12)))
        want = [(m.group(), *m.span()) for m in annotate.WORD.finditer(text)]
        starts, ends = annotate.word_places(text)
        assert annotate.word_list(text) == [w for w, _, _ in want]
        assert list(zip(starts.tolist(), ends.tolist())) == [x[1:] for x in want]
