"""The pipeline's stages against brute force, on the small tables and on odd rows."""

import corpus_pipeline
from skillweave.llm import mixing, toxicity
from skillweave.llm.common import table
from tests.llm import brute
from tests.llm.conftest import SMALL


def test_stages_against_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    columns, rows = docs.columns, {r["doc_id"]: r.asDict() for r in docs.collect()}
    model = toxicity.trained(docs, table(spark, SMALL, "labels"))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    rows = {k: v for k, v in rows.items() if k not in toxic}
    got = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SMALL)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        got[name] = docs
        if i < 4:
            assert docs.columns == columns
    assert {r["doc_id"] for r in got["toxicity"].collect()} == set(rows)
    dropped = {d: h for d, _, _, h in brute.line_dedup([(k, v["text"]) for k, v in rows.items()])}
    after = {r["doc_id"]: r for r in got["line_dedup"].collect()}
    import hashlib
    assert {k: hashlib.sha256(r["text"].encode()).hexdigest() for k, r in after.items()} == dropped
    marks = [(k, brute.fingerprint(r["text"])) for k, r in after.items()]
    kept = {k for (k, _), c in zip(marks, brute.components(marks, lambda a, b: (a ^ b).bit_count() <= 3)) if k == c}
    assert {r["doc_id"] for r in got["simhash_near_dedup"].collect()} == kept and len(kept) < len(marks)
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    clean = {x[0] for x in brute.leaks([(k, after[k]["text"]) for k in kept], items) if not x[-1]}
    assert {r["doc_id"] for r in got["benchmark_decontamination"].collect()} == clean and len(clean) < len(kept)
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(got["benchmark_decontamination"]).collect() if r["copies"]}
    final = got["source_mixing"].groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in final} == want


def test_stages_on_odd_rows(spark, odd_documents):
    for docs in (odd_documents, odd_documents.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            n = out.count()
            if name != "source_mixing":
                assert out.columns == docs.columns and n <= docs.count()
            docs = out if name != "source_mixing" else docs


def test_near_dedup_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, None), (4, ""), (None, "q r s t u")],
                                 "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()
    assert sorted((r["doc_id"] for r in kept), key=repr) == [1, 3, None]


def test_near_dedup_keeps_unlike_texts_without_an_id_or_under_one(spark):
    one, two, three, four = ("alpha beta gamma delta", "one two three four five", "red green blue white", "north south east west")
    rows = [(None, one), (None, two), (None, two), (7, three), (7, four), (8, four), (None, three), (9, "only text here"),
            (9, "only text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()
    want = [(None, one), (None, two), (7, three), (7, four), (9, "only text here")]
    assert sorted(map(tuple, kept), key=repr) == sorted(want, key=repr)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "text", "source", "size", "target", "copy"} <= set(out.columns) and out.count() > 0


def test_columns_of_the_caller_keep_their_values(spark):
    text = "one two three four five six\na line that is long enough to count"
    rows = [(i, text.replace("one", f"w{i} v{i} u{i}"), f"s{i % 2}", 77, 66, 88, "t", {"k": i}) for i in range(6)]
    rows += [(9, "only words here", "s0", 77, 66, 88, a, {"k": 1}) for a in "zxy"]  # rows apart in another column
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int, n_dropped int, size int, "
                                       "target string, extra map<string,int>")
    cleaned = corpus_pipeline.drop_repeated_lines(spark, docs, SMALL)
    assert cleaned.columns == docs.columns  # there is no n_chars, and none comes
    assert {(r.n_lines, r.n_dropped, r.size) for r in cleaned.collect()} == {(77, 66, 88)}
    assert sum("long enough" in r.text for r in cleaned.collect()) == 1
    once = {tuple(map(str, r)) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).where("doc_id = 9").collect()}
    again = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(5, "target"), SMALL).where("doc_id = 9").collect()
    assert len(once) == 1 and once == {tuple(map(str, r)) for r in again}
    mixed = corpus_pipeline.mix_sources(spark, docs, SMALL)
    assert {(r.given_size, r.given_target) for r in mixed.where("doc_id < 9").collect()} == {(88, "t")}
    assert {r["size"] for r in mixed.where("doc_id = 0").collect()} <= {16}


def test_batches_are_bounded_in_bytes(spark):
    docs = table(spark, SMALL, "documents")
    long = spark.range(40).selectExpr("id as doc_id", "repeat('word ', 200000) as text").coalesce(1)

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])
    assert docs.columns and max(r.n for r in long.mapInArrow(sizes, "n long").collect()) <= 6
