"""Packing documents into sequences of bounded length: shortest pack first over the length histogram.

A document is its token ids and an end id. Every ``size`` ids are a full piece, the rest is its tail. Only the histogram
of piece lengths (at most ``size`` numbers) reaches the driver. There lengths are placed longest first, each into the
open packs with the most room, or into new ones; packs of the same make are one pattern with a count, so the work does
not depend on the number of documents. What is left open is closed by cutting: the pieces of the shortest packs, laid
end to end, fill the gaps of the fullest, and the fewer than ``size`` ids left at last are dealt into powers of two, so
no sequence needs padding. A pattern's slot holds pieces of one length with consecutive ranks, one for each pack; pieces
are ranked within their length (by bucket, with offsets from bucket counts, so a length that most pieces have is
spread) and meet their slots by rank. The slots are broadcast: their number depends on ``size`` alone.

Tails travel with their ids only if their length is among those that are cut; their checksums are then made anew.

Defined results: a null or empty text has the end id only. Each row is a document, repeated rows and rows sharing or
lacking a doc_id too. Texts of any length are taken whole. Extra columns, whatever their names, are not read. An empty
table gives no rows. Which of the documents of one length share a sequence is not defined beyond that reading the same
files gives the same.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweave.llm.common import slices, text_buffers
from skillweave.llm.token_counts import _byte_symbols
from skillweave.session import scratch_path

SIZE, END_ID = 1024, 0
#: Pieces in a bucket, the unit of ranking.
BUCKET_ROWS = 1 << 14
#: Fixed value: how byte-level vocabularies of this kind cut a text before merging.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# ---- the plan: from a histogram to patterns ---------------------------------------------------------------------

@dataclass(frozen=True)
class Pattern:
    """``count`` packs of the same make: slots (piece length, first rank), the i-th pack taking rank first + i of each."""

    count: int
    slots: tuple[tuple[int, int], ...] = ()

    @cached_property
    def content(self) -> int:
        return sum(length for length, _ in self.slots)

    def split(self, n: int) -> tuple[Pattern, Pattern | None]:
        """The first ``n`` packs and the others."""
        if n == self.count:
            return self, None
        return Pattern(n, self.slots), Pattern(self.count - n, tuple((length, first + n) for length, first in self.slots))

    def with_pieces(self, length: int, first: int, each: int = 1) -> Pattern:
        """``each`` pieces of a length more in every pack, of the ranks from ``first``."""
        return Pattern(self.count, (*self.slots, *((length, first + i * self.count) for i in range(each))))


def shortest_pack_first(histogram: dict[int, int], size: int) -> tuple[list[Pattern], list[Pattern]]:
    """(full patterns, open patterns) with every piece whole. Each step uses up a length or an open pattern, and at most
    three patterns more are made for a length, so there are at most 3 * size of them."""
    full, by_room, rooms = [], {}, []

    def put(p: Pattern) -> None:
        room = size - p.content
        if not room:
            full.append(p)
            return
        if not by_room.get(room):
            by_room[room] = []
            heapq.heappush(rooms, -room)
        by_room[room].append(p)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            while rooms and not by_room[-rooms[0]]:
                heapq.heappop(rooms)
            if rooms and -rooms[0] >= length:  # the shortest packs take one piece each
                p = by_room[-rooms[0]].pop()
                p, other = p.split(min(left, p.count))
                if other is not None:
                    put(other)
                each = 1
            else:  # none has room: of new packs the shortest is the one just opened, until it is full
                each = min(left, size // length)
                p = Pattern(left // each)
            put(p.with_pieces(length, rank, each))
            rank, left = rank + each * p.count, left - each * p.count
    return full, [p for ps in by_room.values() for p in ps]


class Places:
    """Where each piece goes, by its length and rank.

    Of the open packs the fullest stay, as many as all their ids fill; the pieces of the others are laid end to end, and
    this line is cut where the gaps of the fullest end. What is left of it is dealt into powers of two."""

    def __init__(self, histogram: dict[int, int], size: int = SIZE) -> None:
        histogram = {k: n for k, n in histogram.items() if n}
        full, rest = shortest_pack_first(histogram, size)
        total = sum(p.count * p.content for p in rest)
        keep, handed, stay = total // size, [], []
        for p in sorted(rest, key=lambda p: -p.content):
            n = min(keep, p.count)
            keep -= n
            mine, other = p.split(n) if n else (None, p)
            stay += [mine] if mine else []
            handed += [other] if other else []
        lengths = sorted(histogram)
        #: ranks of all lengths in one line
        self.first = dict(zip(lengths, np.cumsum([0, *(histogram[k] for k in lengths)]).tolist()))
        slots, gaps = [], []  # (place in the line of ranks, whole, sequence or line position, offset or length)
        sequence = 0
        for p in full + stay:
            offset = 0
            for length, first in p.slots:
                slots.append((self.first[length] + first, True, sequence, offset))
                offset += length
            if offset < size:
                gaps.append((size - offset, p.count, sequence, offset))
            sequence += p.count
        for bit in range(size.bit_length() - 1, -1, -1):
            if total % size >> bit & 1:
                gaps.append((1 << bit, 1, sequence, 0))
                sequence += 1
        at = 0
        for p in handed:
            for length, first in p.slots:
                slots.append((self.first[length] + first, False, at, length))
                at += length * p.count
        columns = list(zip(*sorted(slots))) or [()] * 4
        self.rank, self.whole, self.base, self.other = (np.array(c, dtype=np.int64) for c in columns)
        columns = list(zip(*gaps)) or [()] * 4
        self.gap, count, self.sequence, self.offset = (np.array(c, dtype=np.int64) for c in columns)
        self.gap_at = np.cumsum(self.gap * count) - self.gap * count
        #: lengths of which a piece may be cut
        self.cut = sorted({length for p in handed for length, _ in p.slots})
        self.patterns, self.sequences = len(full) + len(rest), sequence

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(piece number, start, length, sequence, offset) of the parts of pieces."""
        names, places = np.unique(length, return_inverse=True)
        at = np.array([self.first[k] for k in names.tolist()], dtype=np.int64)[places] + rank
        slot = np.searchsorted(self.rank, at, side="right") - 1
        nth = at - self.rank[slot]
        whole = self.whole[slot].astype(bool)
        one = np.flatnonzero(whole)
        parts_ = [(one, np.zeros(len(one), np.int64), length[one], (self.base[slot] + nth)[one], self.other[slot][one])]
        # the others, each with its place in the line, gap by gap
        piece = np.flatnonzero(~whole)
        x = (self.base[slot] + nth * length)[piece]
        end, start = x + length[piece], np.zeros(len(piece), np.int64)
        while len(piece):
            g = np.searchsorted(self.gap_at, x, side="right") - 1
            copy, inside = np.divmod(x - self.gap_at[g], self.gap[g])
            n = np.minimum(self.gap[g] - inside, end - x)
            parts_.append((piece, start, n, self.sequence[g] + copy, self.offset[g] + inside))
            more = x + n < end
            piece, start, x, end = piece[more], (start + n)[more], (x + n)[more], end[more]
        return tuple(np.concatenate(c) for c in zip(*parts_))


# ---- pieces -----------------------------------------------------------------------------------------------------

def _byte_level_ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary by bytes, where ids are the order of merges and a text is cut by BYTE_LEVEL only; else None."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    added = spec.get("added_tokens", [])
    vocab = {t: i for t, i in model["vocab"].items() if t not in {x["content"] for x in added}}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    byte_of = {c: i for i, c in enumerate(_byte_symbols())}
    if (spec.get("normalizer") is not None or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True)
            or pre.get("add_prefix_space") or spec.get("post_processor") is not None or model.get("type") != "BPE"
            or model.get("ignore_merges") or model.get("dropout") or model.get("end_of_word_suffix")
            or model.get("continuing_subword_prefix") or any(x["normalized"] for x in added)
            or len(vocab) != 256 + len(pairs) or not set("".join(vocab)) <= byte_of.keys()
            or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs))):
        return None
    return {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items()}


class Encoder:
    """Token ids of texts as the tokenizer library gives them.

    For plain byte-level vocabularies the same merges are run by tiktoken, which takes a quarter of the time; texts that
    hold the string of an added token, and all texts of other tokenizers, are given to the library itself."""

    def __init__(self, file: str) -> None:
        import tiktoken
        spec, self.file = json.loads(file), file
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = _byte_level_ranks(spec)
        self.fast = None if ranks is None else tiktoken.Encoding("plain", pat_str=BYTE_LEVEL, mergeable_ranks=ranks,
                                                                 special_tokens={})

    @cached_property
    def library(self):
        from tokenizers import Tokenizer
        return Tokenizer.from_str(self.file)

    def ids_of(self, texts: list[str]) -> Iterator[np.ndarray]:
        for text in texts:
            if self.fast is None or any(x in text for x in self.added):
                yield np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
            else:
                yield self.fast.encode_to_numpy(text, disallowed_special=())


_ENCODERS: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """The encoder of a tokenizer file; a Python worker keeps the last one between its tasks."""
    if file not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


def tokenised(documents: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID,
              all_ids: bool = False) -> DataFrame:
    """(doc_id, n, start, length, crc, doc_tokens, ids): the pieces of each row of ``documents`` (doc_id, text). ``n``
    numbers a task's pieces. ``ids`` (little-endian bytes, 2 each if the vocabulary allows) is null for full pieces
    unless ``all_ids``. The tokenizer's file is read on the driver and broadcast."""
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    top = max([*spec["model"]["vocab"].values(), end_id, *(t["id"] for t in spec.get("added_tokens", []))])
    kind = np.dtype("<u2" if top < 1 << 16 else "<u4")
    shared = documents.sparkSession.sparkContext.broadcast(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        found, n = encoder(shared.value), 0
        for batch in batches:
            offsets, _ = text_buffers(batch.column(1))
            for i, j in slices(offsets):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                rows: list[tuple] = []
                for doc, own in zip(batch.column(0).slice(i, j - i), found.ids_of(texts)):
                    ids = np.append(own, np.array([end_id], "<u4"))
                    for at in range(0, len(ids), size):
                        own = ids[at:at + size]
                        keep = own.astype(kind).tobytes() if all_ids or len(own) < size else None
                        rows.append((doc.as_py(), n, at, len(own), zlib.crc32(own), len(ids), keep))
                        n += 1
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], batch.column(0).type), *(pa.array(x, pa.int64()) for x in columns[1:6]),
                     pa.array(columns[6], pa.binary())], ["doc_id", "n", "start", "length", "crc", "doc_tokens", "ids"])

    doc = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc}, n long, start long, length long, crc long, doc_tokens long, ids binary"
    pieces = documents.select("doc_id", "text").mapInArrow(run, schema)
    path = scratch_path(documents.sparkSession, "packing-pieces")
    pieces.write.option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.schema(pieces.schema).parquet(path)


# ---- ranks and places -------------------------------------------------------------------------------------------

def ranked(pieces: DataFrame, n_buckets: int) -> DataFrame:
    """``pieces`` with ``rank``, from 0 without gaps among the pieces of each length."""
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "n"), F.lit(n_buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("held"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "n", "crc")
    own = dealt.withColumn("own", F.row_number().over(within))
    return (own.join(offsets, ["length", "bucket"])
            .withColumn("rank", F.col("before") + F.col("own") - 1).drop("bucket", "own", "before"))


def pack(documents: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID,
         all_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of every part of every document; ``ids``
    only with ``all_ids``."""
    spark = documents.sparkSession
    pieces = tokenised(documents, tokenizer_path, size, end_id, all_ids)
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    places = Places(histogram, size)
    shared = spark.sparkContext.broadcast(places)
    if not all_ids:
        pieces = pieces.withColumn("ids", F.when(F.col("length").isin(places.cut), F.col("ids")))
    rows = ranked(pieces, sum(histogram.values()) // BUCKET_ROWS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, length, crc, total, rank = (batch.column(i).to_numpy() for i in (1, 2, 3, 4, 6))
            piece, first, n, sequence, offset = shared.value.of(length, rank)
            crc, ids = crc[piece], batch.column(5).take(pa.array(piece))
            for i in np.flatnonzero(n < length[piece]):
                width = len(ids[i].as_py()) // length[piece[i]]
                own = np.frombuffer(ids[i].as_py(), f"<u{width}")[first[i]:first[i] + n[i]]
                crc[i] = zlib.crc32(own.astype("<u4"))
            if all_ids:
                ids = pa.array([x[f * len(x) // m:(f + k) * len(x) // m] for x, m, f, k in zip(
                    ids.to_pylist(), length[piece].tolist(), first.tolist(), n.tolist())], pa.binary())
            else:
                ids = pa.nulls(len(piece), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(piece)), *(pa.array(x, pa.int64()) for x in (
                    start[piece] + first, n, crc, total[piece], sequence, offset)), ids],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    doc = documents.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "start", "length", "crc", "doc_tokens", "ids", "rank").mapInArrow(
        run, f"doc_id {doc}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, n_parts) of ``pack(..., all_ids=True)``: the ids of each sequence in order, as bytes.
    A sequence has at most ``size`` ids."""
    part = F.struct("offset", "ids", "length")
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return held.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["length"]).alias("length"),
                       joined.alias("ids"), F.size("p").cast("long").alias("n_parts"))


def digest(packed: DataFrame) -> DataFrame:
    return packed.drop("ids")
