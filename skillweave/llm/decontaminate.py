"""Benchmark decontamination by winnowing.

Method: of each span of n consecutive words the smallest k-gram hash (k = n // 2, the rightmost of equals) is kept
as its fingerprint, so any n words that a document shares with a benchmark item give both the same fingerprint.
Fingerprints of documents that miss a fixed-size bitmap of the benchmark's fingerprints are dropped in the scan;
the rest carry the words around them, join the benchmark's spans on the hash (salted, as a passage may lie in a
third of all documents) and are extended: a hit counts only where the n words are equal as strings.

Defined results: a null or empty text has no words and no hits; repeated rows each get their own row; rows that
share a doc_id but not a text are apart; items without words never hit; an item with a null item_id marks words
but is not listed; an empty benchmark hits nothing, and no documents give no rows. Texts of any length are taken whole.
Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.functions.bitmaps import in_bitmap, slot_bitmap
from skillweave.llm.common import WordScanner, row_key, slices, text_buffers, written

#: Words of a span; items of fewer words are one span.
SPAN_WORDS = 10
#: The bitmap takes 2**FILTER_BITS / 8 bytes (4 MB) at any size of the benchmark.
FILTER_BITS = 25
#: Copies of the benchmark's spans that share a hot fingerprint's documents.
SALTS = 8

_MIX = np.uint64(0xD6E8FEB86659FD93)


def kgram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes."""
    n = len(words) - k + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(k):
        out *= _MIX
        out += words[i:i + len(out)]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def window_minima(grams: np.ndarray, w: int) -> np.ndarray:
    """For each window of w grams the index of its smallest, the rightmost of equals."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, w):
        here = grams[j:j + n]
        less = here <= best
        best[less] = here[less]
        at[less] = (np.arange(n) + j)[less]
    return at


def _spans(n: int) -> tuple[int, int]:
    k = max(1, n // 2)
    return k, n - k + 1


def _string(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    return " ".join(data[s:e].tobytes().lower().decode("utf-8", "replace") for s, e in zip(starts, ends))


def _benchmark_spans(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner()
        for batch in batches:
            ids, (offsets, data) = batch.column(0), text_buffers(batch.column(1))
            out: list[list] = [[] for _ in range(5)]
            for row in range(batch.num_rows):
                starts, ends, _, h = scanner.scan(offsets, data, row, row + 1)
                if not len(h):
                    continue
                n = min(n_words, len(h))
                k, w = _spans(n)
                grams = kgram_hashes(h, k)
                for first, at in enumerate(window_minima(grams, w)):
                    for column, value in zip(out, (ids[row], n, int(grams[at].astype(np.int64)), int(at) - first,
                                                   _string(data, starts[first:first + n], ends[first:first + n]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.as_py() for x in out[0]], batch.column(0).type), pa.array(out[1], pa.int32()),
                 pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.string())],
                ["item_id", "n", "h", "lead", "span"])
    return run


def _document_hits(lengths: list[int], bitmap_ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, bitmap = WordScanner(), bitmap_ref.value
        for batch in batches:
            offsets, data = text_buffers(batch.column(2))
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            hits: list[list] = [[] for _ in range(batch.num_rows)]
            for i, j in slices(offsets):
                starts, ends, rows, h = scanner.scan(offsets, data, i, j)
                n_words[i:j] = np.bincount(rows, minlength=j - i)
                first_word = np.searchsorted(rows, np.arange(j - i + 1))
                for n in lengths:
                    k, w = _spans(n)
                    grams = kgram_hashes(h, k)
                    at = window_minima(grams, w)
                    at = at[rows[:len(at)] == rows[n - 1:n - 1 + len(at)]]
                    at = np.unique(at[in_bitmap(bitmap, grams[at])])
                    for pos in at.tolist():
                        row = rows[pos]
                        lo, hi = max(first_word[row], pos - w + 1), min(first_word[row + 1], pos + n)
                        hits[i + row].append({
                            "n": n, "h": int(grams[pos].astype(np.int64)), "pos": int(pos - first_word[row]),
                            "first": int(lo - first_word[row]), "context": _string(data, starts[lo:hi], ends[lo:hi])})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words),
                 pa.array(hits, pa.list_(pa.struct([("n", pa.int32()), ("h", pa.int64()), ("pos", pa.int32()),
                                                    ("first", pa.int32()), ("context", pa.string())])))],
                ["doc_id", "row_key", "n_words", "hits"])
    return run


def leaks(documents: DataFrame, benchmark: DataFrame, n_words: int = SPAN_WORDS) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, row_key, n_words, n_hit, spans (array of [start, end) word
    ranges, merged) and item_ids (array) of the ``benchmark`` (item_id, text) items it shares a span with."""
    spark = documents.sparkSession
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    doc_type = documents.schema["doc_id"].dataType.simpleString()
    items = written(benchmark.select("item_id", "text").mapInArrow(
        _benchmark_spans(n_words), f"item_id {id_type}, n int, h long, lead int, span string"), "bench-spans")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # at most n_words values
    bitmap = spark.sparkContext.broadcast(slot_bitmap(items, "h", FILTER_BITS))
    docs = written(documents.select("doc_id", row_key(), "text").mapInArrow(
        _document_hits(lengths, bitmap),
        f"doc_id {doc_type}, row_key long, n_words long, "
        "hits array<struct<n:int,h:long,pos:int,first:int,context:string>>"), "doc-hits")

    # spans held by the same items share one class, so a document meets each item list once, not once a word
    # (an item counts once for a span that it repeats: equal hashes would cancel out)
    spans = (items.select("n", "h", "lead", "span", "item_id").distinct().groupBy("n", "h", "lead", "span")
             .agg(F.bit_xor(F.xxhash64("item_id", F.lit(1))).alias("a"),
                  F.bit_xor(F.xxhash64(F.lit(2), "item_id")).alias("b"), F.count("*").alias("c")))
    spans = spans.withColumn("held_by", F.concat_ws(":", "a", "b", "c")).drop("a", "b", "c")
    members = (items.select("span", "item_id").distinct().join(spans.select("span", "held_by"), "span")
               .select("held_by", "item_id").where("item_id is not null").distinct())

    found = (docs.where(F.size("hits") > 0).dropDuplicates(["doc_id", "row_key"])
             .select("doc_id", "row_key", F.explode("hits").alias("x")).select("doc_id", "row_key", "x.*")
             .withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS))))
    salted = spans.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    start = F.col("pos") - F.col("lead")
    words = F.slice(F.split("context", " "), F.greatest(start - F.col("first") + 1, F.lit(1)), F.col("n"))
    hit = (found.join(salted, ["n", "h", "salt"])
           .where((start >= F.col("first")) & (F.array_join(words, " ") == F.col("span")))
           .select("doc_id", "row_key", start.alias("start"), (start + F.col("n")).alias("end"), "held_by"))
    ranges = (hit.groupBy("doc_id", "row_key")
              .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
              .select(F.col("doc_id").alias("r_id"), F.col("row_key").alias("r_key"), _merged("s").alias("spans")))
    named = (hit.select("doc_id", "row_key", "held_by").distinct().join(members, "held_by")
             .groupBy("doc_id", "row_key").agg(F.collect_set("item_id").alias("item_ids"))
             .select(F.col("doc_id").alias("m_id"), F.col("row_key").alias("m_key"), "item_ids"))
    both = ranges.join(named, F.col("r_id").eqNullSafe(F.col("m_id")) & (F.col("r_key") == F.col("m_key")), "left")
    none_spans = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    none_items = F.expr(f"cast(array() as array<{id_type}>)")
    out = docs.select("doc_id", "row_key", "n_words").join(
        both, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("row_key") == F.col("r_key")), "left")
    out = out.select("doc_id", "row_key", "n_words", F.coalesce("spans", none_spans).alias("spans"),
                     F.coalesce("item_ids", none_items).alias("item_ids"))
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))
    return out.withColumn("n_hit", length)


def _merged(column: str):
    """Sorted ranges with overlapping and touching ones joined."""
    return F.expr(f"""aggregate({column}, cast(array() as array<struct<start:int,end:int>>), (acc, x) ->
        case when size(acc) > 0 and element_at(acc, -1).end >= x.start
             then concat(slice(acc, 1, size(acc) - 1),
                         array(named_struct('start', element_at(acc, -1).start,
                                            'end', greatest(element_at(acc, -1).end, x.end))))
             else concat(acc, array(x)) end)""")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: item ids as a hash of their sorted, comma-joined strings."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ","), 256)
        .alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
