"""Nearest vectors by multi-index hashing.

Vectors are centred, rotated by a learned rotation (PCA directions turned until their signs lose least) and cut to one
bit per direction. A code is split into substrings of SUB_BITS bits, each with its own bucket index; two codes within
radius r agree in some substring up to r // substrings bits, so probing those buckets of every substring retrieves
every code within r (and a shorter reach where the remainder allows it). Codes in the radius are reranked by the
cosine of the original vectors in double precision.

The index is dealt into blocks of rows and the queries into blocks of queries; one task indexes one block, answers one
block of queries and passes on k rows per query, so neither a hot vector nor a hot bucket leaves its block. A query
that finds too few in a block widens its radius there. Rotation and radius are learned on a bounded sample
(SAMPLE_ROWS); every row is indexed.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without a vec_id, take
no part; nor do vectors of another than the most frequent length (the larger of equals). Rows with the query's vec_id
are its own. Each repeated row is a candidate, a repeated query is asked once; equal scores go by vec_id. Extra columns,
whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweave.llm.common import first_by_hash

K = 5
QUERY_MODULUS = 50
#: Bound of the sample that the rotation and the radius are learned on.
SAMPLE_ROWS = 8_192
CODE_BITS, SUB_BITS = 64, 8
#: Share of the sample's true neighbours that the radius must reach. Neighbours in the whole table are nearer.
REACH = 0.97
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 2_048


class Coder:
    """Learned rotation: bits of a vector, and the radius that reaches its neighbours."""

    def __init__(self, sample: np.ndarray, k: int = K) -> None:
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        bits = min(CODE_BITS, x.shape[1])
        self.mean = x.mean(axis=0)
        centred = x - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, :bits]
        projected = centred @ axes
        turn = np.linalg.qr(np.random.default_rng(0).normal(size=(bits, bits)))[0]
        for _ in range(30):
            u, _, v = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
            turn = (u @ v).T
        self.rotation = axes @ turn
        self.subs = -(-bits // SUB_BITS)
        self.radius = self._radius(x, k)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, substrings) bytes."""
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1)

    def _radius(self, x: np.ndarray, k: int) -> int:
        codes, apart = self.codes(x), []
        for at in range(0, min(len(x), 512), 64):
            s = x[at:at + 64] @ x.T
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
            near = np.argpartition(-s, min(k, len(x) - 1), axis=1)[:, :min(k, len(x) - 1)]
            apart.append(np.bitwise_count(codes[at:at + 64][:, None, :] ^ codes[near]).sum(axis=2).ravel())
        apart = np.concatenate(apart)
        return int(np.quantile(apart, REACH, method="higher")) if len(apart) else CODE_BITS


class MultiIndex:
    """Bucket lists of every substring of a block's codes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.rows = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.bounds = [np.searchsorted(codes[rows, j], np.arange(257)) for j, rows in enumerate(self.rows)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from ``code`` in at most ``radius`` bits, all of them."""
        subs = len(code)
        reach, more = divmod(radius, subs)  # substrings 0..more are probed to reach, the others to reach - 1
        seen = np.zeros(len(self.codes), dtype=bool)
        for j in range(subs):
            r = reach if j <= more else reach - 1
            if r < 0:
                continue
            values = np.flatnonzero(_NEAR[code[j]] <= r)
            starts, ends = self.bounds[j][values], self.bounds[j][values + 1]
            count = ends - starts
            at = np.arange(count.sum()) + np.repeat(starts - (np.cumsum(count) - count), count)
            seen[self.rows[j][at]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def search_block(coder: Coder, k: int, query_ids, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
    """(query position, row, score) of the up to k best rows for each query."""
    index, norms = MultiIndex(coder.codes(vectors)), np.sqrt((vectors * vectors).sum(axis=1))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    codes = coder.codes(queries)
    for i, q in enumerate(queries):
        radius, bits = coder.radius, 8 * codes.shape[1]
        while True:
            rows = index.within(codes[i], radius)
            rows = rows[ids[rows] != query_ids[i]]
            if len(rows) >= k or radius >= bits:
                break
            radius = min(bits, radius + codes.shape[1])
        # one sum per row, the same for equal vectors wherever they lie
        score = (vectors[rows] * q).sum(axis=1) / (norms[rows] * np.sqrt((q * q).sum()))
        best = np.lexsort((ids[rows], -score))[:k]
        out.append((np.full(len(best), i), rows[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors that take part, as doubles."""
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (vectors.where("vec_id is not null and embedding is not null")
            .select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
            .where(sound & F.exists("v", lambda x: x != 0)))


def nearest(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` (vec_id, embedding) where ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1)
    top = lengths.collect()
    if not top:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == top[0]["d"])
    sample = first_by_hash(rows.withColumn("ord", F.xxhash64("vec_id")), "ord", SAMPLE_ROWS).select("v").toPandas()["v"]
    shared = spark.sparkContext.broadcast(Coder(np.stack([np.asarray(x, dtype=np.float64) for x in sample]), k))
    queries = rows.where(is_query).distinct().withColumn("q", F.xxhash64("v"))
    n_rows = -(-top[0]["n"] // BLOCK_ROWS)
    n_queries = -(-queries.count() // BLOCK_QUERIES) or 1
    blocks = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    rows = rows.select(F.explode(blocks(n_queries)).alias("qb"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_rows))
                       .cast("int").alias("rb"), "vec_id", "v")
    queries = queries.select(F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(n_queries)).cast("int").alias("qb"),
                             F.explode(blocks(n_rows)).alias("rb"), "vec_id", "q", "v")

    def run(block, asked):
        if not block.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "q": pa.array([], pa.int64()),
                             "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, own = block.column("vec_id").to_numpy(), asked.column("vec_id").to_numpy()
        i, r, score = search_block(shared.value, k, own, _matrix(asked.column("v")), ids, _matrix(block.column("v")))
        return pa.table({"query_id": own[i], "q": asked.column("q").to_numpy()[i], "vec_id": ids[r], "score": score})

    found = (rows.groupBy("qb", "rb").cogroup(queries.groupBy("qb", "rb"))
             .applyInArrow(run, "query_id long, q long, vec_id long, score double"))
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
