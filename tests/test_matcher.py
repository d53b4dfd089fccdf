"""The block matcher: cogrouped blocks against brute force, pruned lists, nothing through the driver."""

import math
import pathlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillweave.operators import match

CODE = pathlib.Path(match.__file__).read_text(encoding="utf-8")


def grams(text):
    t = f" {text.lower()} "
    return Counter(t[i:i + 3] for i in range(len(t) - 2))


def cosine_top(query, labels, k):
    q, out = grams(query), []
    for o, label in labels:
        c = grams(label)
        dot = sum(n * c[g] for g, n in q.items())
        norm = math.sqrt(sum(n * n for n in q.values())) * math.sqrt(sum(n * n for n in c.values()))
        out.append((-(dot / norm) if norm else 0.0, o))
    return [(o, -s) for s, o in sorted(out)[:k]]


def words(rnd, n, size):
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, size))) for _ in range(n))


@pytest.mark.parametrize("seed, n, letters", [(1, 700, 9), (2, 40, 4), (3, 5, 6), (4, 1500, 3)])
def test_pruned_lists_give_the_exact_best(seed, n, letters):
    rnd = random.Random(seed)
    labels = [(o, words(rnd, rnd.randint(1, 4), letters)) for o in rnd.sample(range(10 * n), n)]
    labels += [(10 * n + 1, labels[0][1]), (10 * n + 2, ""), (10 * n + 3, "Übung ÄÖ 漢字")]
    queries = [words(rnd, rnd.randint(1, 3), letters) for _ in range(60)] + [rnd.choice(labels)[1] for _ in range(60)]
    queries += ["", "a", "übung", labels[0][1]]
    block = match.GramBlock(np.array([o for o, _ in labels]), match.codes_of([f" {t.lower()} " for _, t in labels]))
    got = {}
    for rows, ords, scores in block.best(match.codes_of([f" {t.lower()} " for t in queries]), 3):
        for r, o, s in zip(rows.tolist(), ords.tolist(), scores.tolist()):
            got.setdefault(r, []).append((o, s))
    for i, q in enumerate(queries):
        want = cosine_top(q, labels, 3)
        assert [o for o, _ in got[i]] == [o for o, _ in want]
        assert np.allclose([s for _, s in got[i]], [s for _, s in want], atol=1e-12)


def test_pruning_reads_few_entries():
    """Queries that resemble some concepts read far fewer list entries than there are queries x concepts."""
    rnd = random.Random(9)
    labels = [words(rnd, 3, 9) for _ in range(4_000)]
    queries = [x[:-2] + "zz" for x in rnd.sample(labels, 300)]
    block = match.GramBlock(np.arange(len(labels)), match.codes_of([f" {t} " for t in labels]))
    got = [x for _, ords, _ in block.best(match.codes_of([f" {t} " for t in queries]), 1) for x in ords.tolist()]
    assert [labels[o][:-2] + "zz" for o in got] == queries
    assert block.touched < 0.2 * len(labels) * len(queries)


def test_blocks_of_100_rows_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(350, 6))
    m[200] = m[17]
    rows = [(name, i, (m[i] * f).tolist()) for i in range(350) for name, f in (("a", 1.0), ("b", -1.0)) if i < 300 or name == "a"]
    q = spark.createDataFrame(rows, "model_id string, key long, vec array<double>")
    got = match.dense_top_k(q, q.withColumnRenamed("key", "ord"), 4, budget_bytes=100 * 8 * 6)
    found = sorted((r.model_id, r.key, r.rank, r.ord) for r in got.collect())
    want = []
    for name, n in (("a", 350), ("b", 300)):
        for i in range(n):
            s = (m[:n] * m[i]).sum(axis=1)
            want += [(name, i, r + 1, j) for r, j in enumerate(sorted(range(n), key=lambda j: (-s[j], j))[:4])]
    assert found == sorted(want)


def test_nothing_of_the_matcher_passes_the_driver(spark):
    for word in ("toPandas", "collect(", "first()", "count()", "sparkContext.broadcast", "crossJoin"):
        assert word not in CODE, word
    q = spark.createDataFrame([("m", i, [float(i), 1.0]) for i in range(9)], "model_id string, key long, vec array<double>")
    plan = match.dense_top_k(q, q.withColumnRenamed("key", "ord"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_one_side_or_both_empty(spark):
    q = spark.createDataFrame([("m", 1, [1.0])], "model_id string, key long, vec array<double>")
    none = q.limit(0)
    index = q.withColumnRenamed("key", "ord")
    assert match.dense_top_k(none, index, 2).count() == match.dense_top_k(q, index.limit(0), 2).count() == 0
    assert match.dense_top_k(q, index, 2, exclude_self=True).count() == 0


@pytest.mark.parametrize("kind", ["plain", "ties", "wide", "tiny", "not finite"])
def test_tiles_give_the_exact_best(monkeypatch, kind):
    """Estimates in single precision lose none of the best, whatever the vectors' sizes, ties and order."""
    monkeypatch.setattr(match, "TILE", 64)
    monkeypatch.setattr(match, "CHUNK_BYTES", 8 * 64 * 32)
    rng = np.random.default_rng(7)
    m = rng.normal(size=(500, 12))
    m = m[np.argsort(m[:, 0])]  # nearer ones come last
    if kind == "ties":
        m[100:400] = m[7]
        m[450:] = m[3] * (1 + 1e-12)
    m *= {"wide": 10.0 ** rng.integers(-6, 6, (500, 1)), "tiny": 1e-25}.get(kind, 1.0)
    if kind == "not finite":
        m[5, 2], m[9, 1] = np.inf, 1e30
    block = match.DenseBlock(np.arange(500)[::-1], m[::-1])
    found = [np.concatenate(x) for x in zip(*block.best(m, 4))]
    with np.errstate(invalid="ignore"):
        for i in range(500) if kind != "not finite" else (1, 100, 499):
            s = (m * m[i]).sum(axis=1)
            want = np.lexsort((np.arange(500), -s))[:4]
            assert found[1][found[0] == i].tolist() == want.tolist()
            assert found[2][found[0] == i].tolist() == s[want].tolist()


def test_a_small_index_is_many_tasks(spark):
    """2 MB of vectors met in a single task before, however many cores there were; a few rows still are one block."""
    for size, want in ((2_048_000.0, (6, 6)), (100_000.0, (1, 1)), (float(100 << 20), (6, 6)), (float(320 << 20), (10, 10))):
        got = spark.range(1).select(*match._blocks(F.lit(size), F.lit(size), 32 << 20, match.WAYS)).first()
        assert tuple(got) == want
