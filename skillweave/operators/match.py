"""Similarity matching of texts (queries) against a concept index.

Two encoders share one matcher and its result ``(key, rank, ord, score)``: the min(k, n) best of the n concepts per
query by score, ties broken by the concept ordinal.

* sparse (default, no model): character trigrams of the lower-cased padded text; cosine = integer dot product /
  (norm_q * norm_c). The dot product is an exact integer, so scores and ties are the same in any engine; concepts
  without a common trigram have score 0 and are ranked like any other.
* dense (model slot): vectors, dot product in double precision, summed row by row so that equal vectors have equal
  scores wherever they lie.

Index and queries are dealt by hash into blocks of bounded size, and every block of queries meets every block of the
index in a task of its own (a cogroup on the two block numbers). A pair of blocks hands on k rows per query, merged by
one window. Nothing is read by the driver, neither rows nor counts: the numbers of blocks are aggregates of the plan. A
block of queries is about as large as the index blocks it meets, so no side is copied more often than the other's size
asks for; vectors are cut into ``WAYS`` blocks at least, so no task meets all of a small index with all queries. Inside
a task scores are computed for so many queries at a time that the score matrix stays within ``CHUNK_BYTES``.

The sparse index of a block is inverted: lists by trigram, each with the largest share it can add to a cosine. A query
reads its rarest lists first; the k-th score found there is a bar, and lists which together cannot lift a concept over
it are not read. The concepts met are scored exactly. Where that would cost more than reading all lists, they are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bound of the score matrix that a task holds.
CHUNK_BYTES = 16 << 20
#: Scores this close to the k-th best are recomputed row by row before ranking.
SLACK = 1e-9
#: Blocks of queries are not made smaller than that.
LEAST_BYTES = 256 << 10
#: Each side of vectors is cut into so many blocks even if fewer would hold it, so that a small index is many tasks too.
WAYS = 6
#: Index vectors scored at a time.
TILE = 4096
#: List entries of a query read to find the bar, times k; and how many reads of entries a look-up costs.
SEED, LOOKUP = 8, 8


# --------------------------------------------------------------------------
# kernels
# --------------------------------------------------------------------------
def top_k_rows(scores: np.ndarray, k: int, exact: Callable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k best columns per row, best first, ties by lower column.

    ``exact(rows, columns)`` recomputes the scores of the contenders, where the matrix may be off in its last bits."""
    n_rows, n_cols = scores.shape
    kk = min(k, n_cols)
    if not n_rows or not kk:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0)
    kth = -np.partition(-scores, kk - 1, axis=1)[:, kk - 1]
    rows, cols = np.nonzero(scores >= (kth - (SLACK if exact else 0.0))[:, None])
    values = exact(rows, cols) if exact else scores[rows, cols]
    order = np.lexsort((cols, -values, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    first = np.searchsorted(rows, np.arange(n_rows))
    keep = np.arange(len(rows)) - first[rows] < kk
    return rows[keep], cols[keep], values[keep]


def chunk_rows(n_cols: int, chunk_bytes: int = 0) -> int:
    """Queries scored at a time: their score matrix takes at most ``chunk_bytes``."""
    return max(1, (chunk_bytes or CHUNK_BYTES) // (8 * max(1, n_cols)))


def _rows(vectors) -> np.ndarray:
    return vectors if isinstance(vectors, np.ndarray) else np.vstack([np.asarray(x, dtype=np.float64) for x in vectors])


def _single(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray] | tuple[None, None]:
    """Vectors in single precision and their norms; none where that could overflow."""
    if not np.isfinite(vectors).all() or np.abs(vectors).max(initial=0.0) > 1e15:
        return None, None
    return vectors.astype(np.float32), np.sqrt((vectors * vectors).sum(axis=1))


class DenseBlock:
    """Index vectors in ordinal order.

    Scores are estimated in single precision, tile by tile. What an estimate may be off is bounded by the vectors' norms;
    every vector that could be among the k best within that bound is scored in double precision, row by row, and ranked
    by that score alone. Vectors that do not fit single precision are scored in double precision from the start."""

    def __init__(self, ords: np.ndarray, vectors) -> None:
        order = np.argsort(ords, kind="stable")
        self.ords = ords[order]
        self.mat = _rows(vectors)[order]
        self.low, norms = _single(self.mat)
        self.norm = norms.max(initial=0.0) if norms is not None else 0.0

    def best(self, queries, k: int):
        tile = min(TILE, len(self.ords))
        step = chunk_rows(tile)
        for at in range(0, len(queries), step):
            q = _rows(queries[at:at + step])
            low, norms = _single(q) if self.low is not None else (None, None)
            found = self._whole(q, k) if low is None else [self._tiled(q, low, norms, k, tile)]
            for rows, cols, values in found:
                yield rows + at, self.ords[cols], values

    def _exact(self, q: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(rows)), max(1, CHUNK_BYTES // (8 * max(1, self.mat.shape[1])))
        for a in range(0, len(rows), step):
            out[a:a + step] = (q[rows[a:a + step]] * self.mat[cols[a:a + step]]).sum(axis=1)
        return out

    def _whole(self, q: np.ndarray, k: int):
        step = chunk_rows(len(self.ords))
        for at in range(0, len(q), step):
            part = q[at:at + step]
            rows, cols, values = top_k_rows(part @ self.mat.T, k, lambda r, c: self._exact(part, r, c))  # noqa: B023
            yield rows + at, cols, values

    def _tiled(self, q: np.ndarray, low: np.ndarray, norms: np.ndarray, k: int, tile: int):
        """The best of one chunk of queries; a bar for each query rises from tile to tile."""
        kk, n = min(k, len(self.ords)), len(self.ords)
        # twice the error of an estimate, with as much again to spare; the last term is for products that underflow
        slack = norms * (self.norm * (self.mat.shape[1] + 8) * 2.0 ** -22) + 1e-30
        best = np.full((len(q), kk), -np.inf, dtype=np.float32)
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]

        def settled(rows, cols, values):
            """The k best of what is held, by their exact scores."""
            near = values >= best[rows, -1] - slack[rows]
            rows, cols, values = rows[near], cols[near], values[near]
            exact = self._exact(q, rows, cols)
            keep = _first_of_each(rows, np.lexsort((cols, -exact, rows)), kk)
            return rows[keep], cols[keep], values[keep], exact[keep]

        for a in range(0, n if kk else 0, tile):
            scores = low @ self.low[a:a + tile].T
            if a == 0:
                rows, _, values = top_k_rows(scores, kk)
                best[rows, np.arange(len(rows)) - np.searchsorted(rows, rows)] = values
            at = np.flatnonzero((scores >= (best[:, -1] - slack).astype(np.float32)[:, None]).ravel())
            rows, cols, values = at // scores.shape[1], at % scores.shape[1] + a, scores.ravel()[at]
            if a and len(at):
                top = _first_of_each(rows, np.lexsort((-values, rows)), kk)
                more = np.full_like(best, -np.inf)
                more[rows[top], np.arange(len(top)) - np.searchsorted(rows[top], rows[top])] = values[top]
                best = -np.sort(-np.concatenate([best, more], axis=1), axis=1)[:, :kk]
            held = [np.concatenate(x) for x in zip(held, (rows, cols, values))]
            if len(held[0]) > CHUNK_BYTES // 8:
                held = list(settled(*held)[:3])
        rows, cols, _, exact = settled(*held) if kk else (*held, np.zeros(0))
        return rows, cols, exact


def _first_of_each(rows: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The first k places of each row in ``order``, which goes by row first."""
    mine = rows[order]
    return order[np.arange(len(order)) - np.searchsorted(mine, mine) < k]


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bounds) of the trigrams of texts: a trigram's three code points in one integer."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    grams = np.maximum(lengths - 2, 0)
    bounds = np.concatenate(([0], np.cumsum(grams)))
    at = np.arange(bounds[-1]) + np.repeat(np.cumsum(lengths) - lengths - bounds[:-1], grams)
    return (points[at] << 42) | (points[at + 1] << 21) | points[at + 2], bounds


def _listed(grams) -> tuple[np.ndarray, np.ndarray]:
    """The same from lists of trigrams."""
    if isinstance(grams, tuple):
        return grams
    codes, _ = codes_of([g.ljust(3, "\0") for x in grams for g in x])
    return codes, np.concatenate(([0], np.cumsum([len(x) for x in grams]))).astype(np.int64)


def _counted(owner: np.ndarray, code: np.ndarray, by_code: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, count) of the distinct pairs, in the order of owners or of codes."""
    order = np.lexsort((owner, code) if by_code else (code, owner))
    owner, code = owner[order], code[order]
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])))) if len(code) else order
    return owner[new], code[new], np.diff(np.append(new, len(code)))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start .. start + length - 1 of each list, one after another."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


class GramBlock:
    """Inverted lists of a block of concepts by trigram, with score bounds.

    Concepts and queries are lists of trigrams, or (codes, bounds) as ``codes_of`` gives them. ``touched`` counts the
    list entries read and looked up."""

    def __init__(self, ords: np.ndarray, grams) -> None:
        codes, bounds = _listed(grams)
        order = np.argsort(ords, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.ords, self.n = ords[order], len(order)
        self.pos, code, self.tf = _counted(np.repeat(place, np.diff(bounds)), codes, True)
        self.norms = np.sqrt(np.bincount(self.pos, weights=self.tf * self.tf, minlength=self.n))
        self.codes, self.start = np.unique(code, return_index=True)
        self.length = np.diff(np.append(self.start, len(code)))
        self.key = np.repeat(np.arange(len(self.codes)), self.length) * self.n + self.pos
        self.bound = np.maximum.reduceat(self.tf / self.norms[self.pos], self.start) if len(code) else np.zeros(0)
        self.touched = 0

    def best(self, queries, k: int):
        codes, bounds = _listed(queries)
        step = chunk_rows(self.n)
        for at in range(0, len(bounds) - 1, step):
            part = bounds[at:at + step + 1]
            rows, cols, values = self._best(codes[part[0]:part[-1]], part - part[0], k)
            yield rows + at, self.ords[cols], values

    def _best(self, codes: np.ndarray, bounds: np.ndarray, k: int):
        n_queries = len(bounds) - 1
        q, code, tf = _counted(np.repeat(np.arange(n_queries), np.diff(bounds)), codes, False)
        norm = np.sqrt(np.bincount(q, weights=tf * tf, minlength=n_queries))
        gram = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        known = self.codes[gram] == code if len(self.codes) else np.zeros(len(code), dtype=bool)
        q, gram, tf = q[known], gram[known], tf[known]
        order = np.lexsort((gram, self.length[gram], q))  # rarest lists of each query first
        q, gram, tf = q[order], gram[order], tf[order]
        first = np.searchsorted(q, np.arange(n_queries + 1))
        size = self.length[gram]
        before = _within(size, q, first) - size
        kk = min(k, self.n)
        total = np.bincount(q, weights=size, minlength=n_queries)
        pruned = total > 4 * SEED * kk  # fewer entries are read as they are
        read = before < SEED * kk
        rows, cols = self._met(q, gram, read & pruned[q])
        score = self._scored(rows, cols, q, gram, tf, first, norm)
        bar = _kth(rows, score, n_queries, kk)
        # a concept that has only the grams from here on reaches at most ``rest``
        gain = tf * self.bound[gram] / norm[q]
        rest = np.bincount(q, weights=gain, minlength=n_queries)[q] - (_within(gain, q, first) - gain)
        needed = (rest >= bar[q] - SLACK) | read
        entries = np.diff(first)
        cost = np.bincount(q, weights=size * needed, minlength=n_queries) * (1 + LOOKUP * entries)
        pruned &= (bar > 0) & (cost < total)
        more_r, more_c = self._met(q, gram, needed & pruned[q])
        found = [(more_r, more_c, self._scored(more_r, more_c, q, gram, tf, first, norm))]
        found.append(self._all(np.flatnonzero(~pruned), q, gram, tf, norm, k))
        # concepts without a common gram come last, by ordinal; k of them are enough, less those that were found
        idle = np.flatnonzero(pruned)
        have = np.unique(more_r * self.n + more_c)
        fill = (np.repeat(idle, kk) * self.n + np.tile(np.arange(kk), len(idle)))
        fill = fill[~np.isin(fill, have)]
        found.append((fill // max(1, self.n), fill % max(1, self.n), np.zeros(len(fill))))
        rows, cols, score = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((cols, -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, np.arange(n_queries))[rows] < kk
        return rows[keep], cols[keep], score[keep]

    def _met(self, q: np.ndarray, gram: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (query, concept) pairs of the lists read."""
        size = self.length[gram[read]]
        self.touched += int(size.sum())
        cell = np.unique(np.repeat(q[read], size) * self.n + self.pos[_spread(self.start[gram[read]], size)])
        return cell // max(1, self.n), cell % max(1, self.n)

    def _scored(self, rows, cols, q, gram, tf, first, norm) -> np.ndarray:
        """Exact scores of pairs: each of the query's grams is looked up in the concept."""
        out = np.zeros(len(rows))
        entries = first[rows + 1] - first[rows]
        for a, b in _portions(entries, CHUNK_BYTES // 8):
            e = _spread(first[rows[a:b]], entries[a:b])
            pair = np.repeat(np.arange(b - a), entries[a:b])
            key = gram[e] * self.n + cols[a:b][pair]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            out[a:b] = np.bincount(pair, weights=np.where(self.key[at] == key, tf[e] * self.tf[at], 0), minlength=b - a)
            self.touched += len(e)
        return np.divide(out, norm[rows] * self.norms[cols], out=np.zeros(len(rows)), where=out > 0)

    def _all(self, queries: np.ndarray, q, gram, tf, norm, k: int):
        """The best of ``queries`` by reading all their lists."""
        local = np.full(len(norm), -1, dtype=np.int64)
        local[queries] = np.arange(len(queries))
        mine = local[q] >= 0
        row, gram, tf = local[q[mine]], gram[mine], tf[mine]
        size = self.length[gram]
        self.touched += int(size.sum())
        dot = np.zeros(len(queries) * self.n)
        for a, b in _portions(size, CHUNK_BYTES // 8):
            e = _spread(self.start[gram[a:b]], size[a:b])
            owner = np.repeat(np.arange(a, b), size[a:b])
            cell = row[owner] * self.n + self.pos[e]
            low = int(row[a]) * self.n  # the portion's rows only
            held = np.bincount(cell - low, weights=tf[owner] * self.tf[e])
            dot[low:low + len(held)] += held
        scores = dot.reshape(len(queries), self.n)
        bottom = norm[queries][:, None] * self.norms
        scores = np.divide(scores, bottom, out=np.zeros_like(scores), where=bottom > 0)
        rows, cols, values = top_k_rows(scores, k)
        return queries[rows], cols, values


def _within(values: np.ndarray, q: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums inside each query."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[1:] - total[first[q]]


def _kth(rows: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th highest score of each row, 0 where there are fewer."""
    order = np.lexsort((-score, rows))
    first = np.searchsorted(rows, np.arange(n + 1))
    out, enough = np.zeros(n), np.diff(first) >= k
    out[enough] = score[order][first[:-1][enough] + k - 1] if k else 0
    return out


def _portions(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges whose sizes add up to at most ``limit``, or a single larger one."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right"))
        yield at, max(end, at + 1)
        at = max(end, at + 1)


# --------------------------------------------------------------------------
# matcher
# --------------------------------------------------------------------------
def _blocks(held, asked, budget_bytes: int, ways: int) -> tuple:
    """(blocks of the index, blocks of the queries) for the bytes of both sides, as column expressions: as many as the
    budget asks for, and ``ways`` unless a block got smaller than the least."""
    least = F.lit(float(min(LEAST_BYTES, budget_bytes)))
    some = lambda size: F.least(F.ceil(size / least), F.lit(ways))
    n_index = F.greatest(F.ceil(held / F.lit(float(budget_bytes))), some(held), F.lit(1))
    block = F.greatest(least, held / n_index)
    return n_index, F.greatest(F.ceil(asked / block), some(asked), F.lit(1))


def _match(queries: DataFrame, index: DataFrame, k: int, value: str, held: DataFrame, asked: DataFrame,
           block_type: Callable, read: Callable, budget_bytes: int, ways: int = 1) -> DataFrame:
    """queries (model_id, key, value), index (model_id, ord, value) -> (model_id, key, rank, ord, score); without the
    column model_id all are of one model.

    ``held`` (model_id, held) and ``asked`` (model_id, asked) state the bytes of both sides in memory, ``read`` makes a
    block's values of an Arrow column."""
    model = [c for c in ("model_id",) if c in index.columns]
    # columns of their own for each side, which may be the same table
    own = lambda df, *cs: df.select(*[F.col(c).alias(c) for c in (*model, *cs)])
    queries, index = own(queries, "key", value), own(index, "ord", value)
    if model:
        n_index, n_query = _blocks(F.col("held"), F.col("asked"), budget_bytes, ways)
        blocks = F.broadcast(held.join(asked, model).select(  # one row for each model
            *model, n_index.alias("n_index"), n_query.alias("n_query")))
        queries, index, n_index, n_query = queries.join(blocks, model), index.join(blocks, model), F.col("n_index"), F.col("n_query")
    else:
        n_index, n_query = _blocks(held.scalar(), asked.scalar(), budget_bytes, ways)
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    one_of = lambda c, n: F.pmod(F.xxhash64(c), n.cast("long"))
    left = own(queries.select(*model, one_of("key", n_query).alias("qb"), all_of(n_index).alias("ib"), "key", value),
               "qb", "ib", "key", value)
    right = own(index.select(*model, all_of(n_query).alias("qb"), one_of("ord", n_index).alias("ib"), "ord",
                             F.col(value).alias("own")), "qb", "ib", "ord", "own")
    kind = queries.schema["key"].dataType.simpleString()

    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asked.num_rows and block.num_rows:
            parts += block_type(block["ord"].to_numpy(), read(block["own"])).best(read(asked[value]), k)
        rows, ords, scores = (np.concatenate(x) for x in zip(*parts))
        rows = pa.array(rows.astype(np.int64))
        return pa.table({c: asked[c].take(rows) for c in [*model, "key"]} | {"ord": ords.astype(np.int64), "score": scores})

    by = [*model, "qb", "ib"]
    schema = f"{'model_id string, ' if model else ''}key {kind}, ord long, score double"
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)
    return rank_top_k(found, k, *model, "key").select(*model, "key", "rank", "ord", "score")


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def rank_top_k(scored: DataFrame, k: int, *part: str) -> DataFrame:
    """rank = row_number by score desc, ord asc; keep rank <= k (WindowGroupLimit)."""
    w = Window.partitionBy(*part).orderBy(F.col("score").desc(), F.col("ord").asc())
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def trigrams(text):
    """All character trigrams of ' ' || lower(text) || ' ', repeats included; none for shorter texts."""
    whole = padded(text)
    return F.when(F.length(whole) >= 3, F.transform(F.sequence(F.lit(1), F.length(whole) - 2),
                                                    lambda i: F.substring(whole, i, 3))
                  ).otherwise(F.array().cast("array<string>"))


def padded(text):
    """The text that trigrams are taken from."""
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


def sparse_top_k(queries: DataFrame, concepts: DataFrame, k: int, budget_bytes: int = 64 << 20,
                 q_key: str = "key", q_text: str = "text") -> DataFrame:
    """Top-k concepts (ord, pref_label) per query text by trigram cosine: (key, rank, ord, score)."""
    q = queries.select(F.col(q_key).alias("key"), padded(F.col(q_text)).alias("text"))
    index = concepts.select("ord", padded(F.col("pref_label")).alias("text"))
    # a trigram and its list entries take about 100 bytes
    size = lambda df: df.agg(F.coalesce(100.0 * F.sum(F.length("text")), F.lit(0.0)))
    return _match(q, index, k, "text", size(index), size(q), GramBlock, lambda column: codes_of(column.to_pylist()),
                  budget_bytes)


def dense_top_k(queries: DataFrame, index: DataFrame, k: int, budget_bytes: int = 32 << 20,
                exclude_self: bool = False, counted: DataFrame | None = None) -> DataFrame:
    """Top-k index rows per (model_id, query key) by dot product.

    queries: (model_id, key, vec array<double>); index: (model_id, ord long, vec). Output: (model_id, key, rank, ord,
    score). With ``exclude_self`` (queries and index are the same set, key = ord) the k best other rows are returned:
    the k + 1 best hold them whether or not the row itself is among those. ``counted`` (model_id) has a row for each
    query and is counted in place of ``queries``, whose vectors may be costly to make. Without the column model_id on
    both sides all are of one model."""
    model = [c for c in ("model_id",) if c in index.columns]
    counted = queries if counted is None else counted
    if exclude_self:
        top = dense_top_k(queries, index, k + 1, budget_bytes)
        return rank_top_k(top.filter(F.col("ord") != F.col("key")).drop("rank"), k, *model, "key")
    if not model:
        held = index.agg(F.coalesce(8.0 * F.sum(F.size("vec")), F.lit(0.0)))
        row = index.agg(F.coalesce(8.0 * F.max(F.size("vec")), F.lit(0.0)))
        asked = counted.agg((F.count("*") * row.scalar()).alias("asked"))
        return _match(queries, index, k, "vec", held, asked, DenseBlock, _vectors, budget_bytes, WAYS)
    held = index.groupBy("model_id").agg((8 * F.sum(F.size("vec"))).cast("double").alias("held"),
                                         (8 * F.max(F.size("vec"))).alias("row"))
    n = counted.groupBy("model_id").agg(F.count("*").alias("n"))
    asked = n.join(F.broadcast(held), "model_id").select("model_id", (F.col("n") * F.col("row")).cast("double").alias("asked"))
    return _match(queries, index, k, "vec", held.drop("row"), asked, DenseBlock, _vectors, budget_bytes, WAYS)


def decide(matches: DataFrame, threshold: float) -> DataFrame:
    """accepted only for rank 1 with score >= threshold (inclusive); raw score."""
    ok = (F.col("rank") == 1) & (F.col("score") >= F.lit(threshold))
    return matches.withColumn("decision", F.when(ok, "accepted").otherwise("rejected"))
