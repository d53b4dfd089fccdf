"""Search, archives, quotations, quality and token counts against brute force and round trips."""

import gzip
import hashlib
import io
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skillweave.llm import hamming_search, line_quality, queries, quotations, token_counts, warc
from skillweave.llm.common import WordScanner, table, text_buffers
from skillweave.session import scratch_path
from tests.llm.conftest import ODD_TEXTS, SMALL

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# ---- search ----------------------------------------------------------------------------------------------------

def brute_nearest(rows, k=5, modulus=50):
    rows = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and None not in v]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    out = {}
    for i, q in rows:
        if i % modulus == 0:
            s = sorted((-(v * q).sum() / (np.linalg.norm(v) * np.linalg.norm(q)), j) for j, v in rows if j != i)
            out[i] = [(j, -x) for x, j in s[:k]]
    return out


def test_search_recall_on_the_whole_table(spark):
    d = "/root/testdata/sf0.1"
    got = {}
    for r in queries.op8_multi_index_hashing(spark, d).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest([(r["vec_id"], r["embedding"]) for r in table(spark, d, "embeddings").collect()])
    assert got.keys() == want.keys()
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    exact = {q: dict(want[q]) for q in want}
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == [1, 2, 3, 4, 5]
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        assert all(s == pytest.approx(exact[q][v], abs=1e-12) for _, v, s in rows if v in exact[q])


def test_search_on_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=12)], i) for i in range(160)]
    rows += [(200 + i, rows[0][1], 0) for i in range(40)] + [rows[3], rows[50]]
    rows += [(1000, None, 1), (1001, [0.0] * 12, 1), (1002, [float("nan")] * 12, 1), (1003, [None] + [1.0] * 11, 1),
             (1050, [float("inf")] * 12, 1), (None, rows[2][1], 1), (1100, [1.0, 2.0], 1), (1150, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in hamming_search.nearest(df, "vec_id % 50 = 0").collect():
        got.setdefault(r["query_id"], set()).add((r["rank"], r["vec_id"]))
    single = [(i, [float(np.float32(x)) if x is not None else None for x in v] if v else None) for i, v, _ in rows if i != 1100]
    want = brute_nearest(single)
    assert got.keys() == want.keys()
    assert {v for _, v in got[0]} == {200, 250, 201, 202, 203} - {250} | {204}
    assert hamming_search.nearest(df.limit(0), "vec_id % 50 = 0").count() == 0
    few = hamming_search.nearest(df.where("vec_id in (0, 1, 2)"), "vec_id % 50 = 0").collect()
    assert sorted((r["rank"], r["vec_id"]) for r in few)[0][0] == 1 and len(few) == 2


def test_multi_index_returns_every_code_in_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (3000, 8), dtype=np.uint8)
    codes[1] = codes[0]
    index = hamming_search.MultiIndex(codes)
    for radius in (0, 3, 7, 8, 20, 27, 64):
        for i in (0, 5, 9):
            want = np.flatnonzero(np.bitwise_count(codes ^ codes[i]).sum(axis=1) <= radius)
            assert np.array_equal(index.within(codes[i], radius), want)


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    df = table(spark, SMALL, "embeddings")
    rows = lambda: sorted(tuple(r) for r in hamming_search.nearest(df, "vec_id % 5 = 0").collect())
    monkeypatch.setattr(hamming_search, "REACH", 1.0)
    whole = rows()
    monkeypatch.setattr(hamming_search, "BLOCK_ROWS", 100)
    monkeypatch.setattr(hamming_search, "BLOCK_QUERIES", 16)
    cut = rows()
    assert len(whole) == len(cut) and len(set(whole) & set(cut)) > 0.9 * len(whole)


# ---- archives --------------------------------------------------------------------------------------------------

def pages_expected(rows):
    top = {}
    for i, _, h in rows:
        h = h or ""
        if len(h.encode()) >= 1000 and i is not None:
            top[h] = max(top.get(h, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = (h or "") in top and i != top[h or ""]
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response",
                    top[h or ""] if revisit else None))
    return sorted(out, key=repr)


def odd_pages():
    long, raw = "<p>ä repeated page</p>" * 60, "WARC/1.0\r\n\r\nHTTP/1.0 200 OK\r\n\r\n\n\n http://x 0.0.0.0 1 text/html 5\n"
    rows = [(i, f"http://e.org/{i} x\ty", long) for i in range(9)] + [(8, "http://e.org/8", long)]
    return rows + [(20, None, None), (21, "u", ""), (22, "u", "short"), (23, "u", "short"), (24, "u", raw * 30),
                   (25, "u", raw * 30), (26, "u", raw), (None, "u", long), (None, None, "x" * 2000), (None, None, "x" * 2000),
                   (30, "u", "line\n" * 300_000), (31, "u", "\r\n\r\n" * 400), (32, "u", "x" * 999 + "é")]


def test_archives_round_trip(spark):
    rows = odd_pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", warc.F.lit(1))
    got = warc.round_trip(df.repartition(3)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == pages_expected(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archives_of_the_small_table(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "pages").select("page_id", "url", "html").collect()]
    got = [tuple(r) for r in queries.op2_arc_to_warc(spark, SMALL).collect()]
    assert sorted(got, key=repr) == pages_expected(rows)


def test_written_files_are_arc_and_warc(spark):
    rows = [r for r in odd_pages() if r[0] is not None]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    arcs = warc.write_arc(df, scratch_path(spark, "arc-test"))
    versions, n = set(), 0
    for r in warc.archives(spark, arcs).collect():
        text = gzip.decompress(bytes(r["content"]))
        versions.add(text.split(b"\n")[1].split(b" ")[0])
        n += sum(1 for _ in warc.read_arc(io.BytesIO(text)))
    assert versions == {b"1", b"2"} and n == len(rows)
    out = warc.convert(spark, arcs, scratch_path(spark, "warc-test"))
    seen = {}
    for r in warc.archives(spark, out).collect():
        for fields, block in warc.read_warc(gzip.GzipFile(fileobj=io.BytesIO(bytes(r["content"])))):
            assert len(block) == int(fields["content-length"])
            assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["warc-date"])
            seen[fields["warc-record-id"]] = fields
    for fields in seen.values():
        if fields["warc-type"] == "revisit":
            to = seen[fields["warc-refers-to"]]
            assert to["warc-payload-digest"] == fields["warc-payload-digest"] and to["warc-type"] == "response"


def test_arc_reader_follows_its_version():
    v1 = warc.arc_head(1, "a.arc") + b"\n" + b"http://a b/c 1.2.3.4 19990101 text/html 5\nab\ncd\n" + b"\nhttp://x 1.2.3.4 2000 t/x 9\nshort"
    got = list(warc.read_arc(io.BytesIO(v1)))
    assert [(r["URL"], r["content"], r["truncated"]) for r in got] == [("http://a b/c", b"ab\ncd", False), ("http://x", b"short", True)]
    v2 = warc.arc_head(2, "a.arc") + b"\n" + b"http://a 1.2.3.4 19990101000000 text/html 200 - - 17 a.arc 3\nabc\n"
    assert [(r["Result-code"], r["content"]) for r in warc.read_arc(io.BytesIO(v2))] == [("200", b"abc")]
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(b"http://a 1.2.3.4 1999 text/html 3\nabc\n")))


# ---- quotations ------------------------------------------------------------------------------------------------

def test_quotations_are_linked_and_removed(spark):
    rows = [(1, 0, "user", "First point here.\nSecond   POINT here."),
            (1, 1, "assistant", "> first point HERE.\nYes to that."),
            (1, 2, "user", ">> First point here.\n> yes to that.\n>\nBut why?\n> Second point here.\n> First point here."),
            (1, 3, "assistant", "> never said\n> But why?\nOk"), (1, 4, "user", "  > > Ok\nno > mark"),
            (2, 0, "user", "> first point here.\n"), (2, 1, "user", None), (2, 2, None, ""), (2, 3, "user", ">>>"),
            (None, 1, "user", "> a"), (1, None, "user", "> First point here."), (1, 1, "assistant", "> first point HERE.\nYes to that."),
            (1, 1, "assistant", "another text"), (3, 0, "u", "> x\n" * 3000 + "end")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", warc.F.lit(1))
    got = {(r["conv_id"], r["turn"], r["body"]): (r["max_level"], r["n_passages"], r["n_linked"], r["reply_to"])
           for r in quotations.link(df).collect()}
    assert got == {
        (1, 0, "First point here.\nSecond   POINT here."): (0, 0, 0, None),
        (1, 1, "Yes to that."): (1, 1, 1, 0),
        (1, 2, "But why?"): (2, 3, 2, 1),  # lines in another order are nobody's words
        (1, 3, "Ok"): (1, 1, 0, None),
        (1, 4, "no > mark"): (2, 1, 1, None),
        (2, 0, ""): (1, 1, 0, None), (2, 1, ""): (0, 0, 0, None), (2, 2, ""): (0, 0, 0, None), (2, 3, ""): (3, 0, 0, None),
        (None, 1, ""): (1, 1, 0, None), (1, None, ""): (1, 1, 0, None), (1, 1, "another text"): (0, 0, 0, None),
        (3, 0, "end"): (1, 1, 0, None)}
    assert quotations.link(df).count() == len(rows) and quotations.link(quotations.as_mail(df.limit(0))).count() == 0


def test_passages_are_linked_whole_to_one_message(spark):
    rows = [(1, 0, "Thanks!"), (1, 1, "The build fails"), (1, 2, "Thanks!\nThe build fails\non arm"),
            (1, 3, "> Thanks!\n> The build fails\nFixed"),                                      # said before line by line
            (2, 0, "a b"), (2, 1, "c d"), (2, 2, "> a b\n> c d\nx"),                            # gathered from two messages
            (3, 0, "x y\nz w"), (3, 1, "z  w\n> x y\n\nX Y"), (3, 2, "> z w\n> x y\nok"),     # the one in order
            (4, 0, "p\nq\nr"), (4, 1, "> p\n> r\nno"), (4, 2, "> q\n>\n> r\n> s\nno"),        # not a run, not all said
            (5, 0, "l\n" * 40 + "m"), (5, 1, "> l\n" * 39 + "> m\nlong"), (5, 2, "> l\n" * 41 + "longer"),
            (6, 0, "p\nq"), (7, 0, "> p\n> q\nother conversation")]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["n_passages"], r["n_linked"], r["reply_to"])
           for r in quotations.link(df.union(df.where("turn > 0"))).collect() if r["n_passages"]}
    assert got == {(1, 3): (1, 1, 2), (2, 2): (1, 0, None), (3, 1): (1, 1, 0), (3, 2): (1, 1, 1), (4, 1): (1, 0, None),
                   (4, 2): (1, 0, None), (5, 1): (1, 1, 0), (5, 2): (1, 0, None), (7, 0): (1, 0, None)}


def test_mail_view_links_each_turn_to_the_one_before(spark):
    got = queries.op3_quotation_linking(spark, SMALL).collect()
    text = {(r["conv_id"], r["turn"]): r["text"] for r in table(spark, SMALL, "conversations").collect()}
    assert len(got) == len(text)
    for r in got:
        assert r["body"] == text[r["conv_id"], r["turn"]].strip("\n")
        assert r["n_linked"] == r["n_passages"] == min(r["turn"], 2)
        assert r["reply_to"] is None if r["turn"] == 0 else r["reply_to"] < r["turn"]


def test_quotations_use_no_python(spark):
    plan = queries.op3_quotation_linking(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- quality ---------------------------------------------------------------------------------------------------

def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        unary, change = rng.normal(size=n) * 2, rng.normal(size=2)
        weight = {}
        for code in range(2 ** n):
            y = [code >> t & 1 for t in range(n)]
            weight[tuple(y)] = np.exp(sum(u for u, v in zip(unary, y) if v)
                                      + sum(change[a] for a, b in zip(y, y[1:]) if a == b))
        total = sum(weight.values())
        first = np.array([0, n, n + 1])
        p, bb, gg = line_quality.marginals(first, np.append(unary, 0.3), change)
        assert np.allclose(p[:n], [sum(w for y, w in weight.items() if y[t]) / total for t in range(n)])
        assert np.isclose(p[n], 1 / (1 + np.exp(-0.3)))
        for t in range(1, n):
            assert np.isclose(gg[t - 1], sum(w for y, w in weight.items() if y[t - 1] and y[t]) / total)
            assert np.isclose(bb[t - 1], sum(w for y, w in weight.items() if not y[t - 1] and not y[t]) / total)


def test_lines_are_found_as_they_stand():
    import pyarrow as pa
    texts = ["", "a\n", "\n\n", None, "one line", "x\ny y y!!\n", ""]
    offsets, data = text_buffers(pa.array(texts))
    first, size, x = line_quality.line_features(offsets, data, 0, len(texts), WordScanner())
    assert np.diff(first).tolist() == [len((t or "").split("\n")) for t in texts]
    assert size.tolist() == [len(line) for t in texts for line in (t or "").split("\n")]
    assert x[first[5] + 1, line_quality.FEATURES.index("repeated words")] == pytest.approx(np.sqrt(2 / 3))


def test_quality_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op4_line_crf_quality(spark, d).collect()
    labels = {r["doc_id"]: r["quality"] for r in table(spark, d, "labels").collect()}
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    pos, neg = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert np.mean([[p > n for n in neg] for p in pos]) > 0.97 and np.mean([p == y for _, y, p in held]) > 0.95


def test_quality_on_odd_rows(spark, odd_documents):
    labels = spark.createDataFrame([(4, 1), (4, 0), (7, 0), (None, 1), (999, 1), (6, None), (8, 1)], "doc_id long, quality int")
    rows = line_quality.score(odd_documents, line_quality.trained(odd_documents, labels)).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in line_quality.score(odd_documents, line_quality.trained(odd_documents, labels.limit(0))).collect()} == {0.5}
    assert line_quality.score(odd_documents.limit(0), line_quality.LineField()).count() == 0


# ---- token counts ----------------------------------------------------------------------------------------------

STRANGE = ["<|endoftext|>", "a<|startoftext|><|endoftext|>b <|endoftext", "I'll we've it's 'S don't", "ΑΣ ΣΑΣ Σ ὈΔΥΣΣΕΎΣ",
           "İstanbul ﬁne e\u0301 \u1e9b\u0323", "x\x1cy\x1f z\x85w\u00a0v\u2028u\u200bt", "aaaaaaaaaaaaaaaaaaa" * 40,
           "123 4567 ½ ² Ⅷ", "漢字かな交じり文 🙂🙂🏽 \U0001F468\u200d\U0001F469", "!!! ... ---- $$$ %%% '''s", "\ufeffbom", "\x00nul"]


def test_token_counts_equal_the_library(spark):
    texts = [t for t in ODD_TEXTS if t is not None] + STRANGE
    texts += [r["text"] for r in table(spark, SMALL, "documents").collect()]
    lib = Tokenizer.from_file(WORD_BPE)
    want = [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(df, WORD_BPE).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == want
    assert [got[i]["n_bytes"] for i in range(len(texts))] == [len(t.encode()) for t in texts]
    assert all(got[i]["over_limit"] == (n > 2048) for i, n in enumerate(want))


def test_token_counts_of_odd_rows(spark, odd_documents):
    got = token_counts.count_tokens(odd_documents, WORD_BPE).collect()
    assert len(got) == odd_documents.count() and sum(r["n_bytes"] == 0 and r["n_tokens"] == 0 for r in got) == 3
    assert token_counts.count_tokens(odd_documents.limit(0), WORD_BPE).count() == 0


def test_overlapping_pairs_merge_from_the_left():
    import json
    with open(WORD_BPE, encoding="utf-8") as f:
        merger = token_counts.PairMerger(json.load(f))
    lib = Tokenizer.from_file(WORD_BPE)
    pieces = [c * n for c in ("a", "s", "o", "1", "-", "é") for n in (1, 2, 3, 4, 5, 7, 11)]
    pieces = [p for p in pieces if not p[0].isdigit() or len(p) == 1]
    assert merger.counts([p.encode() for p in pieces]).tolist() == [len(lib.encode(p).ids) for p in pieces]
