"""Ranked lexical search for many items at once, by evaluating what the items share only once.

Items' term sets are cut into shared term sets: terms held by the same items are one set, and the two sets that most
items hold together become a new one, as long as two items share it. The sets are the nodes of a DAG: a node's partial
accumulator of a document is the sum of the impacts of its terms; a joint node adds the accumulators of two others, and
an item adds the few nodes that are left of it. Each accumulator is made once for a document and used by all items above.

Documents are scanned once, where they lie, into a forward index of the terms that occur in items (a written table:
term numbers, frequencies and lengths). Corpus statistics come from that table; then each task accumulates its
documents batch by batch along the DAG, keeps the best ``k`` of every item (a document enters only if it reaches the
item's k-th score so far), and the tasks' lists are merged by windows, salted first.

Items come in blocks of bounded size (``BLOCK_TERMS``; a single larger item is a block of its own), each planned on the
driver and broadcast; a benchmark of any size is a number of blocks, with a scan of the documents each. Joint sets are
mined among the ``MINED`` most shared sets of a block; the others are added up one by one, so that bound changes the
work only.

Score of a document for an item: the sum over the item's distinct terms, once each, of w * ((10**9 tf) div (1000 tf +
20 m)), with w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 50 + (50 n N) div L; integers but for the logarithm.

Defined results: a null or empty text has no term; such documents count for nothing and are never found, such items
find nothing. Rows of items that share an item_id (or have none) are one item with all their terms. Each row of
documents is a document, also where rows repeat or share a doc_id; equal scores go by doc_id, none last. Texts of any
length are taken whole. Words are compared byte by byte, hashes only find them. Extra columns, whatever their names,
are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillweave.llm.common import WordScanner, slices, text_buffers, written

K = 50
#: Bound of a block of items: (item, term) pairs, and ITEM_TERMS more for each item.
BLOCK_TERMS, ITEM_TERMS = 1 << 16, 16
#: Shared term sets among which joint sets are mined.
MINED = 2_048
#: Accumulators held at a time in a task.
BATCH_CELLS = 1 << 21
#: Lower-cased bytes, A-Z only.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
SALTS = 32


# ---- items and their DAG ----------------------------------------------------------------------------------------

def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    words = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                                 F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return items.select("item_id", F.explode(words).alias("term")).distinct()


class Terms:
    """The items' terms for the scan: by hash, with their bytes for the comparison."""

    def __init__(self, terms: list[str]) -> None:
        data = [t.encode() for t in terms]
        raw = np.frombuffer(b"".join(data), dtype=np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in data]))).astype(np.int64)
        _, _, _, hashes = WordScanner().scan(bounds, raw, 0, len(data))
        order = np.argsort(hashes, kind="stable")
        self.hash, self.number, self.start = hashes[order], order.astype(np.int64), bounds[:-1]
        self.length, self.raw = np.diff(bounds), raw
        self.twins = int(np.unique(hashes, return_counts=True)[1].max(initial=1))

    def numbers(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for none."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        if not len(self.hash):
            return out
        first = np.searchsorted(self.hash, hashes)
        for step in range(self.twins):  # more than one only where hashes of terms collide
            at = np.minimum(first + step, len(self.hash) - 1)
            words = np.flatnonzero((self.hash[at] == hashes) & (out < 0))
            term = self.number[at[words]]
            fits = ends[words] - starts[words] == self.length[term]
            words, term = words[fits], term[fits]
            length = self.length[term]
            owner = np.repeat(np.arange(len(words)), length)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
            same = _LOWER[data[starts[words][owner] + inside]] == self.raw[self.start[term][owner] + inside]
            equal = np.ones(len(words), dtype=bool)
            equal[owner[~same]] = False
            out[words[equal]] = term[equal]
        return out


class Dag:
    """Shared term sets of a block of items: ``leaf`` of each term, ``joint`` (two nodes each, in order) and the nodes
    that each item adds up."""

    def __init__(self, term_items: dict[int, list[int]], n_items: int, mined: int = MINED) -> None:
        by_holders: dict[tuple, int] = {}
        self.leaf = {t: by_holders.setdefault(tuple(sorted(held)), len(by_holders)) for t, held in term_items.items()}
        self.n_leaves = len(by_holders)
        items: list[set[int]] = [set() for _ in range(n_items)]
        for holders, node in by_holders.items():
            for i in holders:
                items[i].add(node)
        self.plain_additions = sum(map(len, items))
        shared = sorted((h for h in by_holders if len(h) > 1), key=lambda h: (-len(h), by_holders[h]))[:mined]
        self.joint: list[tuple[int, int]] = []
        if len(shared) > 1:
            self._mine([by_holders[h] for h in shared], shared, items, n_items)
        self.items = [np.array(sorted(x), dtype=np.int64) for x in items]

    def _mine(self, nodes: list[int], holders: list[tuple], items: list[set[int]], n_items: int) -> None:
        rows = sorted({i for h in holders for i in h})
        place = {i: r for r, i in enumerate(rows)}
        room = 2 * len(nodes)  # joint sets beyond that are not looked for
        held = np.zeros((room, len(rows)), dtype=np.float32)
        for n, h in enumerate(holders):
            held[n, [place[i] for i in h]] = 1
        used, name = len(nodes), [*nodes, *([0] * (room - len(nodes)))]
        both = np.zeros((room, room), dtype=np.float32)
        both[:used, :used] = held[:used] @ held[:used].T
        np.fill_diagonal(both, 0)
        best, top = both.argmax(axis=1), both.max(axis=1)
        while used < room:
            a = int(top.argmax())
            if top[a] < 2:
                break
            b = int(best[a])
            joint = held[a] * held[b]
            name[used] = self.n_leaves + len(self.joint)
            self.joint.append((name[a], name[b]))
            for r in np.flatnonzero(joint):
                items[rows[r]] -= {name[a], name[b]}
                items[rows[r]].add(name[used])
            held[used] = joint
            held[a] -= joint
            held[b] -= joint
            used += 1
            for n in (a, b, used - 1):
                line = held[:used] @ held[n]
                line[n] = 0
                both[n, :used] = both[:used, n] = line
            # the lines of a and b only lost; others change where their best was one of them, or by the new set
            stale = np.flatnonzero((best[:used] == a) | (best[:used] == b))
            stale = np.union1d(stale, [a, b, used - 1])
            best[stale] = both[stale, :used].argmax(axis=1)
            better = both[:used, used - 1] > both[np.arange(used), best[:used]]
            best[:used][better] = used - 1
            top[:used] = both[np.arange(used), best[:used]]

    @property
    def additions(self) -> int:
        """Additions of accumulators for a document."""
        return len(self.joint) + sum(map(len, self.items))


class Search:
    """What a task needs to score documents for a block of items."""

    def __init__(self, dag: Dag, weights: dict[int, int], n_terms: int, n_docs: int, n_words: int, k: int) -> None:
        self.leaf, self.weight = np.full(n_terms, -1, dtype=np.int64), np.zeros(n_terms, dtype=np.int64)
        for term, node in dag.leaf.items():
            self.leaf[term], self.weight[term] = node, weights.get(term, 0)
        self.joint, self.items, self.n_leaves = dag.joint, dag.items, dag.n_leaves
        self.n_docs, self.n_words, self.k = n_docs, n_words, k

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """m of documents with n terms."""
        if int(n.max(initial=0)) * 50 * self.n_docs < 1 << 62:
            return 50 + 50 * n * self.n_docs // self.n_words
        return np.array([50 + 50 * int(x) * self.n_docs // self.n_words for x in n], dtype=np.int64)

    def scores(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(items, documents) from postings (doc, term, tf) and the documents' numbers of terms."""
        node = self.leaf[term]
        mine = node >= 0
        doc, term, tf, node = doc[mine], term[mine], tf[mine], node[mine]
        impact = self.weight[term] * (1_000_000_000 * tf // (1_000 * tf + 20 * self.lengths(n)[doc]))
        partial = np.zeros((self.n_leaves + len(self.joint), len(n)), dtype=np.int64)
        # sums of a cell stay below 2**53, so doubles hold them exactly
        cells = np.bincount(node * len(n) + doc, weights=impact, minlength=self.n_leaves * len(n))
        partial[:self.n_leaves] = cells.reshape(self.n_leaves, len(n)).astype(np.int64)
        for i, (a, b) in enumerate(self.joint, self.n_leaves):
            np.add(partial[a], partial[b], out=partial[i])
        out = np.zeros((len(self.items), len(n)), dtype=np.int64)
        for i, nodes in enumerate(self.items):
            if len(nodes):
                np.add.reduce(partial[nodes], axis=0, out=out[i])
        return out

    def batch(self) -> int:
        return max(16, BATCH_CELLS // max(1, self.n_leaves + len(self.joint) + len(self.items)))


class Best:
    """The best k of every item so far: by score, then id, none last."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k, self.floor = k, np.ones(n_items, dtype=np.int64)
        self.parts: list[tuple] = []
        self.held, self.limit = 0, 4 * k * max(1, n_items)

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.floor[:, None])
        self.parts.append((item, scores[item, doc], ids[doc], no_id[doc]))
        self.held += len(item)
        if self.held > self.limit:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        item, score, ids, no_id = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (
            np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        order = np.lexsort((ids, no_id, -score, item))
        item, score, ids, no_id = item[order], score[order], ids[order], no_id[order]
        at = np.arange(len(item)) - np.searchsorted(item, np.arange(len(self.floor)))[item]
        keep = at < self.k
        last = at == self.k - 1
        self.floor[item[last]] = score[last]
        self.parts = [(item[keep], score[keep], ids[keep], no_id[keep])]
        self.held = int(keep.sum())
        return self.parts[0]


# ---- the forward index ------------------------------------------------------------------------------------------

def forward_index(documents: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs): per document with terms its number of terms and, as bytes of 32-bit integers, the items'
    terms in it and how often each occurs. Written once."""
    shared = documents.sparkSession.sparkContext.broadcast(Terms(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner()
        for batch in batches:
            offsets, data = text_buffers(batch.column(1))
            for i, j in slices(offsets):
                starts, ends, rows, hashes = scanner.scan(offsets, data, i, j)
                n = np.bincount(rows, minlength=j - i)
                number = shared.value.numbers(hashes, starts, ends, data)
                cell, tf = np.unique((rows << 32 | number)[number >= 0], return_counts=True)
                owner, term = cell >> 32, (cell & 0xFFFFFFFF).astype("<u4").tobytes()
                tf = tf.astype("<u4").tobytes()
                bounds = 4 * np.searchsorted(owner, np.arange(j - i + 1))
                live = np.flatnonzero(n > 0)
                cut = lambda x: pa.array([x[bounds[r]:bounds[r + 1]] for r in live], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(live)), pa.array(n[live]),
                                                  cut(term), cut(tf)], ["doc_id", "n", "terms", "tfs"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary"), "forward-index")


def _postings(batch: pa.RecordBatch, terms: int, tfs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists, often = batch.column(terms).to_pylist(), batch.column(tfs).to_pylist()
    doc = np.repeat(np.arange(len(lists)), [len(x) // 4 for x in lists])
    return doc, *(np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (lists, often))


def document_frequencies(index: DataFrame, n_terms: int) -> DataFrame:
    """(term, df): counted in each task, then added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            held += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=n_terms)
        term = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(held[term])], ["term", "df"])
    return index.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


# ---- search -----------------------------------------------------------------------------------------------------

def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _top(index: DataFrame, search: Search) -> DataFrame:
    """(item, doc_id, score): the best of every task."""
    shared = index.sparkSession.sparkContext.broadcast(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        best, step = Best(len(s.items), s.k), s.batch()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                scores = s.scores(*_postings(part, 2, 3), part.column(1).to_numpy())
                ids = part.column(0)
                best.add(scores, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        item, score, ids, no_id = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=no_id), pa.array(score)],
                                         ["item", "doc_id", "score"])
    return index.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item long, doc_id long, score long")


def blocks(pairs: DataFrame, limit: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, block): items dealt by hash into blocks, more of them until each is within the limit or one item."""
    sizes = written(pairs.groupBy("item_id").agg((F.count("*") + ITEM_TERMS).alias("size")), "item-sizes")
    n = (sizes.agg(F.sum("size")).first()[0] or 0) // limit + 1
    while True:
        dealt = sizes.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)))
        held = dealt.groupBy("block").agg(F.sum("size").alias("size"), F.count("*").alias("items"))
        if held.where((F.col("size") > limit) & (F.col("items") > 1)).isEmpty():
            return dealt.select("item_id", "block")
        n *= 2


def _best_first() -> list:
    return [F.desc("score"), F.col("doc_id").asc_nulls_last()]


def search_block(documents: DataFrame, pairs: DataFrame, k: int) -> DataFrame | None:
    """(item_id, doc_id, score): the best ``k`` or more for one block of (item_id, term); None without any document."""
    spark = documents.sparkSession
    rows = pairs.toArrow()  # a block
    ids, words = rows["item_id"].to_pylist(), rows["term"].to_pylist()
    items = {x: i for i, x in enumerate(dict.fromkeys(ids))}
    terms = {t: i for i, t in enumerate(dict.fromkeys(words))}
    term_items: dict[int, list[int]] = {}
    for item, term in zip(ids, words):
        term_items.setdefault(terms[term], []).append(items[item])
    index = forward_index(documents, list(terms))
    total = index.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    if not total["docs"]:
        return None
    df = {r["term"]: r["df"] for r in document_frequencies(index, len(terms)).collect()}  # the block's terms
    weights = {t: weight(total["docs"], n) for t, n in df.items()}
    dag = Dag(term_items, len(items))
    found = _top(index, Search(dag, weights, len(terms), total["docs"], total["words"], k))
    kind = pairs.schema["item_id"].dataType
    named = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", pairs.schema["item_id"].dataType)])
    names = spark.createDataFrame([(i, x) for x, i in items.items()], named)
    return written(found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"), "search-best")


def search(documents: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best of ``documents`` (doc_id, text) for each of ``items`` (item_id,
    text)."""
    pairs = written(item_terms(items), "item-terms")
    dealt = written(blocks(pairs, block_terms).withColumnRenamed("item_id", "id"), "item-blocks")
    found = None
    for (block,) in dealt.select("block").distinct().orderBy("block").toLocalIterator():
        own = dealt.where(F.col("block") == block).select("id")
        part = search_block(documents, pairs.join(own, F.col("item_id").eqNullSafe(F.col("id"))).drop("id"), k)
        found = part if found is None or part is None else found.unionByName(part)
    if found is None:
        kind = items.schema["item_id"].dataType.simpleString()
        return documents.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*_best_first())))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*_best_first())).cast("int")
    ranked = some.where(F.col("r") <= k).select("item_id", "doc_id", "score").withColumn("rank", rank)
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
