"""Shared-term search, packing and hard negatives against plain restatements, with odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillweave.llm import hard_negatives, packing, shared_search
from tests.llm.brute import AZ, WORD
from tests.llm.conftest import SMALL

TOKENIZER = "byte_bpe_50k.json"


# ---- op11 -------------------------------------------------------------------------------------------------------

def ranked(documents, items, k):
    words = [WORD.findall((t or "").translate(AZ)) for _, t in documents]
    n_docs, n_words = sum(map(bool, words)), sum(map(len, words))
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(WORD.findall((text or "").translate(AZ)))
    df = {}
    for w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, terms in asked.items():
        found = []
        for (doc, _), w in zip(documents, words):
            score = 0
            for t in terms & set(w):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                tf, m = w.count(t), 50 + 50 * len(w) * n_docs // n_words
                score += weight * (10**9 * tf // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return out


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("block_terms", [1 << 16, 60])
def test_search_equals_brute_force_in_one_block_and_in_many(spark, block_terms):
    rnd = random.Random(4)
    vocab = ["w%d" % i for i in range(60)] + ["Straße", "漢字", "ÄB"]
    text = lambda n: " ".join(rnd.choice(vocab[:rnd.choice([5, 63])]).upper() for _ in range(n))
    docs = [(i, text(rnd.randint(0, 30))) for i in range(300)] + [(300 + i, "same words here w1") for i in range(80)]
    items = [(i, text(rnd.randint(0, 25))) for i in range(25)] + [(7, "w1 extra"), (None, "here W2"), (90, None), (91, "zzz")]
    got = shared_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                               spark.createDataFrame(items, "item_id long, text string"), 20, block_terms)
    assert as_rows(got) == sorted(ranked(docs, items, 20), key=repr)


def test_search_on_odd_rows(spark, odd_documents):
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()]
    items = [(1, "the line WORD word ünïcode x"), (2, ""), (3, "x" * 5000), (None, "end")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("clash"))
    assert as_rows(shared_search.search(odd_documents, benchmark)) == sorted(ranked(docs, items, 50), key=repr)
    assert shared_search.search(odd_documents.limit(0), benchmark).count() == 0
    assert shared_search.search(odd_documents, benchmark.limit(0)).count() == 0


def test_dag_adds_up_each_item_once_and_saves_additions():
    rnd = random.Random(2)
    common = rnd.sample(range(400), 12)
    held = [set(rnd.sample(range(400), 10)) | set(rnd.sample(common, 8)) for _ in range(80)]
    by_term = {}
    for i, x in enumerate(held):
        for t in x:
            by_term.setdefault(t, []).append(i)
    for mined in (2_048, 5, 0):
        dag = shared_search.Dag(by_term, len(held), mined)
        terms = {}
        for t, node in dag.leaf.items():
            terms.setdefault(node, set()).add(t)
        for n, (a, b) in enumerate(dag.joint, dag.n_leaves):
            assert not terms[a] & terms[b]
            terms[n] = terms[a] | terms[b]
        for i, nodes in enumerate(dag.items):
            parts = [t for n in nodes.tolist() for t in terms[n]]
            assert sorted(parts) == sorted(held[i])
        assert dag.additions <= dag.plain_additions
    assert shared_search.Dag(by_term, len(held)).additions < 0.8 * dag.plain_additions


def test_terms_whose_hashes_collide_are_told_apart():
    terms = shared_search.Terms(["abc", "xyz", "q"])
    terms.hash, terms.number, terms.twins = np.array([5, 5, 9], np.uint64), np.array([0, 1, 2]), 2
    data = np.frombuffer(b"XYZ abc abd q", np.uint8)
    got = terms.numbers(np.array([5, 5, 5, 9], np.uint64), np.array([0, 4, 8, 12]), np.array([3, 7, 11, 13]), data)
    assert got.tolist() == [1, 0, -1, 2]


# ---- op12 -------------------------------------------------------------------------------------------------------

def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path(TOKENIZER)
    return path, Tokenizer.from_file(path)


def check_packed(parts, ids, size):
    """Every id of every document in one part, sequences gapless; returns the sequences' lengths."""
    by_doc, by_sequence = {}, {}
    for p in parts:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert by_doc.keys() == ids.keys()
    for doc, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            part = np.array(ids[doc][p.start:p.start + p.length], "<u4")
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[doc]) and p.ids_crc32 == zlib.crc32(part.tobytes())
            at += p.length
        assert at == len(ids[doc])
    lengths = []
    for ps in by_sequence.values():
        at = 0
        for offset, n in sorted(ps):
            assert offset == at
            at += n
        assert at <= size
        lengths.append(at)
    return lengths


def test_packing_of_the_small_table(spark):
    path, tokenizer = library()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    parts = packing.pack(docs, path).collect()
    lengths = check_packed(parts, ids, 1024)
    assert all(n == 1024 or n & (n - 1) == 0 for n in lengths)  # no sequence needs padding
    assert len(lengths) <= sum(map(len, ids.values())) // 1024 + 10


def test_packing_of_odd_texts_and_the_sequences_themselves(spark, odd_documents):
    path, tokenizer = library()
    texts = [r.text for r in odd_documents.collect()] + ["a <|endoftext|>  b<|endoftext|>", "x " * 70_000, "é" * 9_000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, length string")
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    packed = packing.pack(docs, path, 64, all_ids=True).persist()
    lengths = check_packed(packed.collect(), ids, 64)
    assert sorted(lengths)[2:] == [64] * (len(lengths) - 2) or all(n & (n - 1) == 0 for n in lengths)
    rows = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert sum(r.length for r in rows.values()) == sum(map(len, ids.values()))
    for p in packed.collect()[::50]:
        whole = np.frombuffer(bytes(rows[p.sequence_id].ids), "<u2")
        assert whole[p.offset:p.offset + p.length].tolist() == ids[p.doc_id][p.start:p.start + p.length]
    packed.unpersist()
    assert packing.pack(docs.limit(0), path).count() == 0
    same = docs.where("doc_id = 4").select(F.lit(None).cast("long").alias("doc_id"), "text")
    assert packing.pack(same.unionByName(same), path).count() == 2  # repeated rows without an id are documents each


def test_ids_are_those_of_the_library():
    path, tokenizer = library()
    encoder = packing.Encoder(open(path).read())
    assert encoder.fast is not None
    rnd = random.Random(0)
    parts = [" "] * 6 + list("abZ9é漢 \n\t.,'!-_  \x1c\x85́😀") + ["<|endoftext|>", "'s", "'re", "  "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(3_000)]
    texts += [f"a{chr(c)}b {chr(c)}c1{chr(c)}2 {chr(c)}." for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.ids_of(texts)] == want


@pytest.mark.parametrize("seed", range(6))
def test_places_hold_every_piece_once_without_padding(seed):
    rnd = random.Random(seed)
    size = 128
    histogram = [{5: 1003}, {70: 501, 3: 2}, {k: 1 for k in range(1, 129)}, {127: 400, 128: 3},
                 {k: rnd.randint(0, 60) for k in range(1, 129)}, {1: 1}][seed]
    places = packing.Places(histogram, size)
    length = np.repeat(list(histogram), list(histogram.values())).astype(np.int64)
    rank = np.concatenate([np.arange(n) for n in histogram.values()])
    piece, start, n, sequence, offset = places.of(length, rank)
    assert (np.bincount(piece, weights=n, minlength=len(length)) == length).all()
    for owner, at in ((piece, start), (sequence, offset)):
        order = np.lexsort((at, owner))
        o, a, m = owner[order], at[order], n[order]
        same = np.append(False, o[1:] == o[:-1])
        assert (a[~same] == 0).all() and (a[same] == (a + m)[:-1][same[1:]]).all()
    filled = np.bincount(sequence, weights=n).astype(int)
    assert all(x == size or x & (x - 1) == 0 for x in filled) and filled.max() <= size
    assert places.patterns <= 3 * size and len(filled) == places.sequences


# ---- op13 -------------------------------------------------------------------------------------------------------

def negatives(rows, is_anchor, k=10, n=5):
    usable = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows
              if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, q in dict.fromkeys((i, lab, tuple(q)) for i, lab, q in usable if is_anchor(i)):
        scored = [(-max(-2**62, min(2**62, sum(a * b for a, b in zip(q, w)))), j, other) for j, other, w in usable if j != i]
        positives = sorted((s, j) for s, j, other in scored if other == lab)[:n]
        for s, p in positives:
            inside = sorted((t, j) for t, j, other in scored if other != lab and 30 * -s <= 100 * -t <= 90 * -s)[:k]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(inside)]
    return out


@pytest.mark.parametrize("seed, big", [(1, 0), (2, 3), (3, 0)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed, big):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 90)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "CHUNK_SCORES", 200)
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(400, 6)) * 0.4
    v[50:90] = v[50]  # a group of copies
    v[:big] *= 1e9
    label = np.where(rng.random(400) < 0.4, 1, rng.integers(0, 4, 400))
    rows = [(i, v[i].tolist(), int(label[i])) for i in range(400)]
    rows += [(20, v[3].tolist(), 2), (20, v[3].tolist(), 2), (401, None, 1), (402, v[0].tolist(), None), (403, [0.0] * 6, 1),
             (404, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (405, [float("nan")] * 6, 1), (500, [float("inf")] + [0.0] * 5, 0),
             (None, v[1].tolist(), 1), (410, [1.0] * 3, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hard_negatives.mine(df.withColumn("rank", F.lit("clash")), F.col("vec_id") % 10 == 0)
    want = negatives([r for r in rows if r[0] != 410], lambda i: i % 10 == 0)
    assert as_rows(got) == sorted(want, key=repr)


def test_hard_negatives_of_little(spark):
    df = spark.createDataFrame([(0, [0.5, 0.5], 1), (1, [0.5, 0.4], 1), (2, [0.3, 0.2], 2)],
                               "vec_id long, embedding array<float>, label int")
    assert as_rows(hard_negatives.mine(df, F.col("vec_id") == 0)) == [(0, 1, 1, 2, 29_440, 16_256)]
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert hard_negatives.mine(df.where("label = 2"), F.col("vec_id") == 2).count() == 0


def test_the_new_queries_are_registered():
    import __spark_entry__ as E
    names = E.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in (11, 12, 13))
    assert {"op11_shared_term_search", "op13_slot_hard_negatives"} <= E.oracle_sql().keys()
