"""SimHash near-duplicates by pivot distance tables.

Each distinct fingerprint gets its Hamming distances to PIVOTS reference fingerprints. As a distance to a reference
changes by at most one per differing bit, fingerprints within ``max_bits`` of each other differ by at most
``max_bits`` in every coordinate. The first coordinates cut the space into cells: a fingerprint lies in its own cell
and is shown to each cell that its distances +- max_bits reach. Inside a cell (large cells are cut into tiles, so no
task holds a cell whole) pairs are discarded by their largest coordinate difference over all references and the
survivors verified bit by bit. A tile passes on a spanning forest of its links, never all pairs of a group; connected
components follow from min-label contraction over written tables.

Copies share one fingerprint and are one node from the start. Defined results: texts with fewer than ``shingle`` words
are one shingle; texts without words (null, empty) have fingerprint zero and link like any other; repeated rows each
get a row; the component of documents without any doc_id is null. Texts of any length are taken whole; a bit that half
of the shingles set is not set. Extra columns, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.llm.common import SLICE_BYTES, row_key, written

SHINGLE_WORDS, MAX_BITS, SEED = 3, 3, 42
PIVOTS = 32
#: Rows of either side that one task compares at once.
TILE = 8192
#: Rows of tiles that one task takes.
TASK_ROWS = 100_000
#: Width of a cell in distance units: a range of +-3 around a distance meets two cells at most.
CELL = 7
SALTS = 16


# ---- fingerprints ----------------------------------------------------------------------------------------------

def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends + 1 - lengths
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, dtype=np.int64), len(words) - k + 1
    for at in range(0, n, 1 << 14):  # bounded memory for very long texts
        stop = min(n, at + (1 << 14))
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:stop].tolist(),
                                                                ends[at + k - 1:stop + k - 1].tolist())], dtype=np.uint64)
        total += _bits(h).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(documents: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, row_key, fp): the 64-bit fingerprint of each row as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))],
                                             ["doc_id", "row_key", "fp"])
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", row_key(), "text").mapInArrow(run, f"doc_id {kind}, row_key long, fp long")


# ---- pivot table and links -------------------------------------------------------------------------------------

def references(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: rows of the 64 x 64 Sylvester matrix, any two of which differ in 32 bits, so that
    their distances tell as much as they can."""
    bits = np.array([[bin(i & j).count("1") & 1 for j in range(64)] for i in range(64)], dtype=np.uint8)
    order = np.random.default_rng(3).permutation(64)[:n]
    return np.packbits(bits[order], axis=1).view(">u8").ravel().astype(np.uint64)


def distances(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)


def n_cell_pivots(n: int) -> int:
    """Coordinates that make the cells; one more for each 16-fold number of fingerprints."""
    return max(2, math.ceil(math.log2(max(n, 2)) / 4))


def _to_cells(j: int, max_bits: int, cell: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = references()[:j]
        weight = 16 ** np.arange(j - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(fps), 20_000):
                fp = fps[at:at + 20_000]
                d = distances(fp.view(np.uint64), refs).astype(np.int64)
                own = (d // cell) @ weight
                reach = np.zeros(len(fp), dtype=np.int64)
                row = np.arange(len(fp))
                for c in range(j):  # one coordinate after the other: each cell that d - max_bits .. d + max_bits meets
                    lo = np.maximum(d[row, c] - max_bits, 0) // cell
                    count = (d[row, c] + max_bits) // cell - lo + 1
                    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    reach = np.repeat(reach, count) + (np.repeat(lo, count) + step) * weight[c]
                    row = np.repeat(row, count)
                    less = reach <= (own[row] // weight[c]) * weight[c]  # each pair is met from its larger cell
                    reach, row = reach[less], row[less]
                home = np.zeros(len(fp) + len(row), dtype=bool)
                home[:len(fp)] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([own, reach])), pa.array(np.concatenate([fp, fp[row]])), pa.array(home)],
                    ["cell", "fp", "home"])
    return run


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mask of links that join two parts not yet joined by those before."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = np.zeros(len(a), dtype=bool)
    for i, (x, y) in enumerate(zip(flat[:len(a)].tolist(), flat[len(a):].tolist())):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[i] = True
    return keep


def tile_links(home: np.ndarray, shown: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between ``home`` and ``shown`` fingerprints at most ``max_bits`` apart. Both are swept in the
    order of one reference's distances, so that blocks out of reach are skipped whole."""
    refs = references()
    none = np.zeros(0, dtype=np.uint64)
    left, right = none, none
    dh, ds = distances(home, refs), distances(shown, refs)
    order = np.argsort(ds[:, -1], kind="stable")
    shown, ds = shown[order], ds[order]
    order = np.argsort(dh[:, -1], kind="stable")
    home, dh = home[order], dh[order]
    for at in range(0, len(home), 128):
        h, d = home[at:at + 128], dh[at:at + 128]
        lo = np.searchsorted(ds[:, -1], d[0, -1] - max_bits)
        hi = np.searchsorted(ds[:, -1], d[-1, -1] + max_bits, side="right")
        if lo == hi:
            continue
        x, y = None, None
        for c in range(refs.size - 1, -1, -1):  # the largest coordinate difference, one coordinate at a time
            if x is None:
                near = np.abs(d[:, c][:, None] - ds[lo:hi, c][None, :]) <= max_bits
                if c > refs.size - 4:
                    for c2 in (c - 1, c - 2, c - 3):
                        near &= np.abs(d[:, c2][:, None] - ds[lo:hi, c2][None, :]) <= max_bits
                x, y = np.nonzero(near)
                y = y + lo
            else:
                near = np.abs(d[x, c] - ds[y, c]) <= max_bits
                x, y = x[near], y[near]
            if not len(x):
                break
        if not len(x):
            continue
        true = (np.bitwise_count(h[x] ^ shown[y]) <= max_bits) & (h[x] != shown[y])
        if true.any():
            left, right = np.concatenate([left, h[x[true]]]), np.concatenate([right, shown[y[true]]])
            keep = _forest(left, right)
            left, right = left[keep], right[keep]
    return left, right


def links(classes: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``classes`` (fp) that connect all within ``max_bits``."""
    j = n_cell_pivots(classes.count())
    width = max(CELL, 2 * max_bits + 1)
    cells = written(classes.select("fp").mapInArrow(_to_cells(j, max_bits, width), "cell long, fp long, home boolean"),
                    "pivot-cells")
    # only cells of more than one tile are looked up: at most rows / tile of them, whatever the number of cells
    large = written(
        cells.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("n_home"),
                                  F.sum((~F.col("home")).cast("long")).alias("n_shown"))
        .select("cell", F.ceil(F.col("n_home") / tile).cast("int").alias("th"),
                F.ceil(F.col("n_shown") / tile).cast("int").alias("ts")).where("th > 1 or ts > 1"), "pivot-tiles")
    placed = cells.join(large, "cell", "left").withColumns({c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
                                                            for c in ("th", "ts")})
    dealt = F.pmod(F.xxhash64("fp", F.lit(1)), F.when(F.col("home"), F.col("th")).otherwise(F.col("ts"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("ts")).otherwise(F.col("th")) - 1))
    placed = placed.withColumn("own", dealt).withColumn("other", other).select(
        "cell", "fp", "home", F.when(F.col("home"), F.col("own")).otherwise(F.col("other")).alias("h"),
        F.when(F.col("home"), F.col("other")).otherwise(F.col("own")).alias("s"))

    def run(data: pa.Table) -> pa.Table:
        fp = data.column("fp").to_numpy().view(np.uint64)
        home = data.column("home").to_numpy()
        a, b = tile_links(fp[home], fp[~home], max_bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    # a tile is small but dear to compare, so tasks are counted by rows, not by bytes
    tasks = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), cells.count() // TASK_ROWS)
    return placed.repartition(tasks, "cell", "h", "s").groupBy("cell", "h", "s").applyInArrow(run, "a long, b long")


# ---- components ------------------------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) with the smallest node it is connected to. Alternates large-star
    and small-star steps, each over a written table, until nothing changes; rounds grow with the logarithm."""
    both = written(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
                   .distinct(), "cc")
    while True:
        # large star: every larger neighbour points at the smallest node around
        around = both.select("v", "u").union(both.select("u", "v")).toDF("x", "y")
        least = around.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = (around.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u"))
                 .where("v <> u").distinct())
        # small star: smaller neighbours and the node itself point at the smallest
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array("v", "u")).alias("v"), F.col("m").alias("u"))
        after = written(small.where("v <> u").distinct(), "cc")
        # done when no node is both a child and a parent and no child has two parents
        many = after.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
        chained = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("v")
        if many.union(chained).isEmpty():
            return after.select(F.col("v").alias("node"), F.col("u").alias("root"))
        both = after


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, row_key, fp, root (one fingerprint that stands for the row's
    component, with or without ids) and component_id, the smallest doc_id reachable."""
    marks = written(fingerprints(documents, shingle), "simhash")
    classes = written(marks.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-classes")
    roots = components(links(classes, max_bits)).withColumnsRenamed({"node": "fp"})
    joined = classes.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    linked = joined.where(F.col("n") > 1).select("root").union(roots.select("root")).distinct()
    joined = joined.join(linked, "root", "left_semi")
    low = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(low, "root").select("fp", "root", "component_id").withColumn(
        "salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    out = marks.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(named, ["fp", "salt"], "left")
    return out.select("doc_id", "row_key", "fp", F.coalesce("root", "fp").alias("root"),
                      F.coalesce("component_id", "doc_id").alias("component_id"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
