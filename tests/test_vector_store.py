"""The versioned vector table: concurrent refreshes, compaction, abandoned pointers."""

import threading

import pytest
from pyspark.sql import functions as F

from skillweave.session import hadoop_path, scratch_path
from skillweave.sources import vector_store as V


def labels(spark, names):
    return spark.createDataFrame([(f"u{n}", f"label {n}") for n in names], "uri string, pref_label string")


def entries(spark, path):
    rows = [tuple(r) for r in V.table(spark, path).select(*V.KEY).collect()]
    assert len(rows) == len(set(rows))
    return {r[1] for r in rows}


def test_two_refreshes_at_once_leave_one_row_per_key(spark):
    path, barrier, added = scratch_path(spark, "vec-race"), threading.Barrier(2), []
    plain = V.trigram_encoder()

    def encode(missing):
        barrier.wait(60)  # both have looked at the same version before either commits
        return plain(missing)

    def work(names):
        added.append(V.refresh(spark, path, labels(spark, names), "trigram", encode))
    threads = [threading.Thread(target=work, args=(range(a, a + 20),)) for a in (0, 10)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(200)
    assert entries(spark, path) == {f"u{n}" for n in range(30)}
    assert sorted(added) in ([10, 20], [20, 10]) and V.version(spark, path)[0] == 2


def test_many_refreshes_are_compacted_and_old_folders_go(spark, monkeypatch):
    monkeypatch.setattr(V, "MAX_GENERATIONS", 2)
    path, encode = scratch_path(spark, "vec-many"), V.trigram_encoder()
    for n in range(4):
        assert V.refresh(spark, path, labels(spark, range(n + 1)), "trigram", encode) == 1
    assert entries(spark, path) == {f"u{n}" for n in range(4)}
    assert len(V.version(spark, path)[1]) <= 2
    assert V.vacuum(spark, path) > 0
    assert entries(spark, path) == {f"u{n}" for n in range(4)}
    assert V.refresh(spark, path, labels(spark, range(4)), "trigram", encode) == 0


def test_a_pointer_left_empty_is_passed_over(spark, monkeypatch):
    monkeypatch.setattr(V, "POINTER_SECONDS", 0)
    path, encode = scratch_path(spark, "vec-left"), V.trigram_encoder()
    V.refresh(spark, path, labels(spark, range(2)), "trigram", encode)
    fs, p = hadoop_path(spark, f"{path}/_versions/{2:010d}")
    assert fs.createNewFile(p)
    assert entries(spark, path) == {"u0", "u1"}
    assert V.refresh(spark, path, labels(spark, range(3)), "trigram", encode) == 1
    assert V.version(spark, path)[0] == 3 and entries(spark, path) == {"u0", "u1", "u2"}


def test_repeated_concepts_make_one_entry_and_a_lost_folder_is_an_error(spark):
    path, encode = scratch_path(spark, "vec-twice"), V.trigram_encoder()
    twice = labels(spark, range(3)).unionByName(labels(spark, range(3)))
    assert V.refresh(spark, path, twice, "trigram", encode) == 3
    assert V.current_vectors(spark, path, twice, "trigram").count() == 3
    assert V.table(spark, scratch_path(spark, "vec-none")).count() == 0
    (name,) = V.version(spark, path)[1]
    fs, folder = hadoop_path(spark, f"{path}/{name}")
    fs.delete(folder, True)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        V.table(spark, path).agg(F.count("*")).collect()
