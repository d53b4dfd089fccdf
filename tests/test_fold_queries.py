"""The queries behind the fold, with more rows in a partition than one Arrow batch holds."""

import pytest

from skillweave.plans import registry

PASSAGES = ["alpha bravo charlie delta", "echo foxtrot golf hotel", "india juliett kilo lima", "mike november oscar papa",
            "quebec romeo sierra tango"]
N = 60


def write_tables(spark, folder):
    """Each document states its passage twice, the next one once, in lines of which some hold a marker."""
    docs = []
    for i in range(N):
        first, second = PASSAGES[i % 5], PASSAGES[(i + 1) % 5]
        no = "nicht" if i % 3 else "wohl"
        docs.append((i, f"Zeile {i}.\n{no} {first}.\n\nx {second}.\n\nauch {first}.", "de", f"s{i % 4}", 0))
    vectors = [(i, [1.0, (i % 7) / 7, (i % 11) / 11, (i % 3) / 3], i % 2) for i in range(2 * N)]
    for name, rows, schema in (
            ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
            ("benchmark", list(enumerate(PASSAGES)), "item_id long, text string"),
            ("embeddings", vectors, "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


QUERIES = ["turtle_documents", "dense_requirements", "conforms", "triples"]


def forget(spark):
    for flow in registry._FLOWS.values():
        flow.release()
    registry._FLOWS.clear()
    spark.catalog.clearCache()


def rows_of(spark, name, folder):
    return sorted(map(str, registry.QUERIES[name](spark, folder).collect()))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("tables"))


@pytest.fixture(scope="module")
def whole(spark, folder):
    """What the queries return when a batch holds all rows; the flow is forgotten, so that it is made again in batches."""
    forget(spark)
    out = {name: rows_of(spark, name, folder) for name in QUERIES}
    forget(spark)
    yield out
    forget(spark)


@pytest.mark.parametrize("name", QUERIES)
def test_batches_of_two_rows_change_nothing(spark, folder, whole, name):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        cut = rows_of(spark, name, folder)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert cut == whole[name]
    if name == "turtle_documents":  # two passages a document
        assert len(cut) == N and all(r.count("a ont:QualificationRequirement") == 2 for r in cut)
    if name == "triples":
        assert sum("hasRequirement" in r for r in cut) == 2 * N
    if name == "conforms":
        assert len(cut) == 2
    if name == "dense_requirements":
        assert len({r.split("posting_id='")[1].split("'")[0] for r in cut}) == 3  # 50 vectors each
