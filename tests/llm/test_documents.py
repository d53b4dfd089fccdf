"""Operators on documents against brute force, and on odd rows."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skillweave.llm import decontaminate, line_dedup, mixing, queries, simhash, toxicity
from skillweave.llm.common import WordScanner, table, text_buffers
from tests.llm import brute
from tests.llm.conftest import SMALL


def pairs(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def test_leaks_on_the_small_tables(spark):
    docs, items = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    got = [tuple(r) for r in queries.op1_winnowing_decontamination(spark, SMALL).collect()]
    want = brute.leaks(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    assert ordered(got) == ordered(want) and any(r[-1] for r in want)


def test_leaks_on_odd_rows(spark, odd_documents):
    items = spark.createDataFrame(
        [(1, "the THE the"), (2, None), (3, ""), (4, "word " * 12), (5, "漢字 1234567890 ünïcode"), (None, "rather long here"),
         (7, "other text under the same id"), (7, "x" * 5000), (9, "the the the")], "item_id long, text string")
    got = [tuple(r) for r in decontaminate.digest(decontaminate.leaks(odd_documents, items)).collect()]
    assert ordered(got) == ordered(brute.leaks(pairs(odd_documents, "doc_id", "text"), pairs(items, "item_id", "text")))


def test_leaks_planted_anywhere_and_overlapping(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(400)]
    item = list(rng.choice(words, 40))
    rows = []
    for i in range(60):
        w = list(rng.choice(words, rng.integers(5, 80)))
        a = int(rng.integers(0, 30))
        n = int(rng.integers(8, 13))
        at = int(rng.integers(0, len(w)))
        rows.append((i, " ".join(w[:at] + item[a:a + n] + w[at:])))
    items = [(1, " ".join(item)), (2, " ".join(item[5:25])), (3, " ".join(item[:4]))]
    got = decontaminate.digest(decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"),
                                                   spark.createDataFrame(items, "item_id long, text string")))
    assert ordered(tuple(r) for r in got.collect()) == ordered(brute.leaks(rows, items))


def test_leaks_of_items_that_repeat_a_span(spark):
    items = [(1, "ha " * 11), (2, "na " * 11), (3, "la " * 12), (4, "la " * 11), (5, "la " * 11)]
    docs = [(1, "ha " * 11), (2, "na " * 11), (3, "la " * 10), (4, "ha " * 10 + "na " * 10), (5, "ha na")]
    got = decontaminate.digest(decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                                                   spark.createDataFrame(items, "item_id long, text string")))
    assert ordered(tuple(r) for r in got.collect()) == ordered(brute.leaks(docs, items))


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).first()["n_hit"] == 0


def test_line_dedup_on_odd_rows(spark, odd_documents):
    state = line_dedup.LineDedupState.of(odd_documents)
    got = [tuple(r) for r in line_dedup.digest(state.clean(odd_documents)).collect()]
    assert ordered(got) == ordered(brute.line_dedup(pairs(odd_documents, "doc_id", "text")))
    assert set(odd_documents.columns) <= set(state.clean(odd_documents).columns)
    assert line_dedup.LineDedupState.of(odd_documents.limit(0)).clean(odd_documents.limit(0)).count() == 0


def test_line_dedup_full_shards_give_the_same_result(spark, odd_documents):
    state = line_dedup.LineDedupState.of(odd_documents)
    full = spark.createDataFrame([(s, b"", True) for s in range(line_dedup.SHARDS)], "shard int, cells binary, full boolean")
    got = line_dedup.digest(line_dedup.clean(odd_documents, state.counts, full))
    assert ordered(tuple(r) for r in got.collect()) == ordered(brute.line_dedup(pairs(odd_documents, "doc_id", "text")))


def test_line_dedup_is_reversible(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    first, more = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    state = line_dedup.LineDedupState.of(first)
    before = ordered(tuple(r) for r in line_dedup.digest(state.clean(first)).collect())
    grown = state.add(more)
    got = ordered(tuple(r) for r in line_dedup.digest(grown.clean(docs)).collect())
    assert got == ordered(brute.line_dedup(pairs(docs, "doc_id", "text")))
    back = grown.delete(more)
    assert ordered(tuple(r) for r in line_dedup.digest(back.clean(first)).collect()) == before
    held = {r["shard"]: bytes(r["cells"]) for r in back.filters.collect()}
    once = {r["shard"]: bytes(r["cells"]) for r in state.filters.collect()}
    filled = lambda x: {s: sum(1 for v in np.frombuffer(c, np.uint16) if v) for s, c in x.items()}
    assert {s: n for s, n in filled(held).items() if n} == {s: n for s, n in filled(once).items() if n}


def test_cuckoo_filter_holds_what_it_was_given():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 60_000, dtype=np.uint64)
    f = line_dedup.CuckooFilter()
    f.insert(h)
    assert f.holds(h).all() and not f.full
    other = rng.integers(0, 1 << 63, 60_000, dtype=np.uint64)
    assert f.holds(other).mean() < 0.001
    f.delete(h[:30_000])
    assert f.holds(h[30_000:]).all() and f.holds(h[:30_000]).mean() < 0.001
    f.insert(rng.integers(0, 1 << 63, 120_000, dtype=np.uint64))
    assert f.full and f.holds(other).all()


def test_mixing_targets_follow_the_stated_rule(spark, odd_documents):
    for docs in (odd_documents, table(spark, SMALL, "documents")):
        got = mixing.mix(docs).select("source", "source_size", "target").distinct().collect()
        want = brute.waterfill({r["source"]: r["source_size"] for r in got})
        assert {r["source"]: pytest.approx(r["target"]) for r in got} == want


def test_mixing_copies(spark, odd_documents):
    rows = mixing.mix(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert int(rate) <= r["copies"] <= min(2, int(rate) + 1)
    assert mixing.emit(mixing.mix(odd_documents)).count() == sum(r["copies"] for r in rows)
    again = mixing.mix(odd_documents.repartition(3)).collect()
    assert ordered((r["doc_id"], r["copies"]) for r in rows) == ordered((r["doc_id"], r["copies"]) for r in again)
    assert mixing.mix(odd_documents.limit(0)).count() == 0


def test_simhash_on_odd_rows_and_small_tables(spark, odd_documents):
    near = lambda a, b: (a ^ b).bit_count() <= 3
    for docs in (odd_documents, table(spark, SMALL, "documents")):
        rows = pairs(docs, "doc_id", "text")
        marks = [(d, brute.fingerprint(t)) for d, t in rows]
        want = [(d, f"{fp:016x}", c) for (d, fp), c in zip(marks, brute.components(marks, near))]
        got = [tuple(r) for r in simhash.digest(simhash.near_duplicates(docs)).collect()]
        assert ordered(got) == ordered(want)
    assert simhash.near_duplicates(odd_documents.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [16, 8192])
def test_simhash_links_every_pair_in_reach(spark, tile):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = [int(x) for x in base]
    for x in fps[:40]:  # chains of copies, each up to 4 bits from the one before
        for _ in range(int(rng.integers(1, 9))):
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps = sorted(set(fps))
    signed = [(x - (1 << 64) if x >= 1 << 63 else x,) for x in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), tile=tile)
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = brute.components([(s[0], x) for s, x in zip(signed, fps)], lambda a, b: (a ^ b).bit_count() <= 3)
    groups = {}
    for (s,), c in zip(signed, want):
        groups.setdefault(c, set()).add(root.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({next(iter(g)) for g in groups.values()})


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


def test_toxicity_learns_and_holds_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op5_ftrl_toxicity(spark, d).collect()
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, d, "labels").collect()}
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    pos, neg = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert np.mean([[p > n for n in neg] for p in pos]) > 0.9
    assert np.mean([p == y for _, y, p in held]) > 0.9


def test_toxicity_trains_on_all_features_of_whole_texts(monkeypatch):
    text = " ".join(f"w{i}" for i in range(25_000))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 0], pa.int32()), pa.array([text, "a b"])],
                                       ["ord", "label", "text"])
    (out,) = toxicity._features(iter([batch]))
    _, _, rows, h = WordScanner().scan(*text_buffers(pa.array([text])), 0, 1)
    assert out.column(2)[0].as_py() == sorted(set(toxicity._slots(h, rows)[1].tolist()))
    lists = pa.array([[i % 3, 5 + i] for i in range(60)], pa.list_(pa.int32()))
    rows = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([i % 3 == 0 for i in range(60)]).cast(pa.int32()), lists],
                                      ["ord", "label", "features"])
    fit = lambda *batches: [b.to_pydict() for b in toxicity._fit(iter(batches))]
    some, whole = fit(rows.slice(0, 45)), fit(rows)
    monkeypatch.setattr(toxicity, "SAMPLE_FEATURES", 91)
    assert fit(rows) == fit(rows.slice(0, 30), rows.slice(30)) == some != whole


def test_toxicity_on_odd_rows(spark, odd_documents):
    labels = spark.createDataFrame([(4, 1), (4, 0), (7, 0), (None, 1), (999, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.trained(odd_documents, labels)
    rows = toxicity.score(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    empty = toxicity.trained(odd_documents, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(odd_documents, empty).collect()} <= {0, 1}
    assert toxicity.score(odd_documents.limit(0), model).count() == 0


def test_queries_keep_the_columns_of_their_contracts(spark):
    for name, want in {"op6_cuckoo_line_dedup": "doc_id n_lines n_dropped kept_sha256",
                       "op7_source_mixing": "doc_id size source_size target taken"}.items():
        assert queries.QUERIES[name](spark, SMALL).columns == want.split()
    text = "a" * 30
    assert line_dedup.digest(spark.createDataFrame([(1, text, 1, 0)], "doc_id long, text string, n_lines long, n_dropped long")
                             ).first()["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert F is not None
