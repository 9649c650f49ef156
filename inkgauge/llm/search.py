"""Top-k search by inner product: a stated query set against all rows, in blocks.

Rows are dealt into blocks of bounded size by hash, queries into chunks of bounded size; each pair of
block and chunk is one unit of work, and a query's best rows of all blocks are merged by a windowed rank. Within a
block equal vectors are searched once, with their smallest ids, so that a vector that fills a third of the table costs
no more than any other. Two searches run inside a block: collision counting (approximate) and the threshold algorithm
(exact).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW

BLOCK_ROWS, CHUNK_ROWS = 8192, 16384
Search = Callable[[np.ndarray, np.ndarray, int], list[tuple[np.ndarray, np.ndarray]]]


def usable(vectors: DataFrame, id_col: str, vec_col: str, zero: bool, element: Callable[[Column], Column]) -> DataFrame:
    """__id, __vec, __width of the rows that take part.

    Vectors that are null, empty, hold null or non-finite components, or (unless zero) are zero don't, nor do rows
    without id. Every other row does, also if its id or its vector repeats.
    """
    v = F.col(f"`{vec_col}`").cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    if not zero:
        good &= F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.coalesce(good, F.lit(False)) & F.col(f"`{id_col}`").isNotNull())
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.transform(v, element).alias("__vec"), F.size(v).alias("__width"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(flat).reshape(-1, width) if flat else np.zeros((0, width))


def search_blocks(rows: DataFrame, is_query: Column, k: int, search: Search, score_type: str, block_rows: int, chunk_rows: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of each query, ties to the smaller vec_id, never its own id.

    Only vectors of one length have an inner product, so each length has blocks and chunks of its own. Queries that
    share an id share one list of k.
    """
    lengths = rows.groupBy("__width").agg(F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("q")).where("q > 0")
    parts = lengths.select("__width", F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows)).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("q") / chunk_rows)).cast("int").alias("chunks"))
    # one row for each length that a query has
    rows = rows.join(F.broadcast(parts) if parts.limit(FEW + 1).count() <= FEW else parts, "__width")
    # by a number of the row's own, given before rows are repeated: an id or a vector that repeats is spread like any other
    rows, own = rows.withColumn("__own", F.monotonically_increasing_id()), F.col("__own")
    dealt = rows.select("__width", F.pmod(F.xxhash64(own), F.col("blocks")).cast("int").alias("__block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("__chunk"), "__id", "__vec")
    asked = rows.where(is_query).select(F.col("__width").alias("__width"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("__block"), F.pmod(F.xxhash64(own, F.lit(1)), F.col("chunks")).cast("int").alias("__chunk"), F.col("__id").alias("__id"), F.col("__vec").alias("__vec"))
    kind = pa.int64() if score_type == "long" else pa.float64()

    def unit(key: tuple, block: pa.Table, chunk: pa.Table) -> pa.Table:
        ids, asks = block["__id"].to_numpy(), chunk["__id"].to_numpy()
        out_q, out_v, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64 if score_type == "long" else float)]
        if len(ids) and len(asks):
            width = key[0].as_py()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], matrix(block["__vec"], width)[order]
            distinct, inverse = np.unique(x, axis=0, return_inverse=True)
            by = np.argsort(inverse.ravel(), kind="stable")
            first = np.searchsorted(inverse.ravel()[by], np.arange(len(distinct)))
            size = np.diff([*first, len(by)])
            # of k others and the rows of the query's own id, k are left; a vector's smallest ids come first
            mine = np.searchsorted(ids, asks, "right") - np.searchsorted(ids, asks, "left")
            for own, more, (which, score) in zip(asks, mine, search(distinct, matrix(chunk["__vec"], width), k + int(mine.max())), strict=True):
                take = np.minimum(size[which], k + more)
                at = np.repeat(first[which], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
                v, s = ids[by[at]], np.repeat(score, take)
                v, s = v[keep := v != own], s[keep]
                best = np.lexsort((v, -s))[:k]
                out_q.append(np.full(len(best), own))
                out_v.append(v[best])
                out_s.append(s[best])
        return pa.table({"query_id": pa.array(np.concatenate(out_q), pa.int64()), "vec_id": pa.array(np.concatenate(out_v), pa.int64()), "score": pa.array(np.concatenate(out_s), kind)})

    unit_of = ["__width", "__block", "__chunk"]
    found = dealt.groupBy(*unit_of).cogroup(asked.groupBy(*unit_of)).applyInArrow(unit, f"query_id long, vec_id long, score {score_type}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def at_least_kth(which: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Those not under the k-th best score, ties included."""
    if len(score) > k:
        keep = score >= np.partition(score, len(score) - k)[len(score) - k]
        which, score = which[keep], score[keep]
    return which, score


@functools.lru_cache(maxsize=8)
def window_ratio(projections: int, threshold: int, sure: float) -> float:
    """Half window over distance at which a vector collides threshold times with probability sure.

    One projection of a vector at distance d lies within h of the query's with probability 2 Phi(h / d) - 1.
    """
    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        tail = sum(math.comb(projections, i) * p**i * (1 - p) ** (projections - i) for i in range(threshold, projections + 1))
        low, high = (low, p) if tail >= sure else (p, high)
    return NormalDist().inv_cdf((1 + high) / 2)


def collision_search(projections: int, share: float, sure: float, first: float, widen: float, seed: int) -> Search:
    """Collision counting over query-centred windows.

    Inner product becomes distance by one more component that gives all vectors the largest length of the block; the
    query is scaled to that length. Each projection is one sorted array. Windows around the query's own projections
    widen by virtual rehashing; a vector in at least share of the windows is verified by its exact inner product. A
    query ends when the windows are so wide that a vector as near as its k-th best would have been verified with
    probability sure, or when all are.
    """
    need = math.ceil(share * projections)
    ratio = window_ratio(projections, need, sure)

    def search(x: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        n = len(x)
        square = (x * x).sum(1)
        longest = math.sqrt(square.max())
        lifted = np.c_[x, np.sqrt(np.maximum(square.max() - square, 0))] / longest
        scaled = np.c_[queries / np.sqrt((queries * queries).sum(1))[:, None], np.zeros(len(queries))]
        axes = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, projections))
        shadow, asked = (lifted @ axes).T, scaled @ axes
        order = np.argsort(shadow, 1).astype(np.int32)
        values = np.take_along_axis(shadow, order, 1)
        widths = [first]
        while widths[-1] <= np.abs(values).max() + np.abs(asked).max():
            widths.append(widths[-1] * widen)
        left = np.array([[np.searchsorted(values[p], asked[:, p] - h, "left") for p in range(projections)] for h in widths])
        right = np.array([[np.searchsorted(values[p], asked[:, p] + h, "right") for p in range(projections)] for h in widths])
        out = []
        for i in range(len(queries)):
            hits, done = np.zeros(n, np.int32), np.zeros(n, bool)
            which, score = np.zeros(0, np.int64), np.zeros(0)
            size = np.linalg.norm(queries[i])
            a = b = None
            for level, h in enumerate(widths):
                lo, hi = left[level, :, i], right[level, :, i]
                if a is None:
                    parts = [order[p, lo[p] : hi[p]] for p in range(projections)]
                else:
                    parts = [order[p, s:e] for p in range(projections) for s, e in ((lo[p], a[p]), (b[p], hi[p])) if s < e]
                a, b = lo, hi
                if parts:
                    hits += np.bincount(np.concatenate(parts), minlength=n).astype(np.int32)
                new = np.flatnonzero((hits >= need) & ~done)
                if len(new):
                    done[new] = True
                    which, score = np.concatenate([which, new]), np.concatenate([score, x[new] @ queries[i]])
                if len(which) == n:
                    break
                if len(which) >= k:
                    kth = np.partition(score, len(score) - k)[len(score) - k]
                    if h >= ratio * math.sqrt(max(0.0, 2 - 2 * kth / (size * longest))):
                        break
            out.append(at_least_kth(which, score, k))
        return out

    return search


def threshold_search(x: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Fagin's threshold algorithm over one sorted list for each dimension, exact.

    Lists are read from the end that is best for the query's sign, in steps that double. Every row met is scored in
    full. No row that isn't met can beat the bound, the score of the last values read; the search ends when the k-th
    score is over the bound (an equal one could still lose a tie), or when all rows are met.
    """
    n, d = x.shape
    largest = max(np.abs(x).max(initial=0), np.abs(queries).max(initial=0))
    if d * largest * largest >= 2**63:
        raise OverflowError("a score doesn't fit a long")
    exact = x if d * largest * largest < 2**53 else x.astype(np.int64)
    up = np.argsort(x, 0, kind="stable").T.astype(np.int32)
    values = np.take_along_axis(x.T, up, 1)
    out = []
    for q in queries:
        w = q if exact is x else q.astype(np.int64)
        plus, minus = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = np.zeros(n, bool)
        which, score = np.zeros(0, np.int64), np.zeros(0, exact.dtype)
        depth, step = 0, 64
        while depth < n:
            to = min(n, depth + step)
            met = np.concatenate([up[plus, n - to : n - depth].ravel(), up[minus, depth:to].ravel()])
            fresh = np.zeros(n, bool)
            fresh[met] = True
            new = np.flatnonzero(fresh & ~seen)
            seen |= fresh
            which, score = np.concatenate([which, new]), np.concatenate([score, exact[new] @ w])
            depth, step = to, step * 2
            if len(which) == n:
                break
            if len(which) >= k:
                bound = values[plus, n - depth] @ q[plus] + values[minus, depth - 1] @ q[minus]
                if np.partition(score, len(score) - k)[len(score) - k] > bound:
                    break
        if len(which) < n and not (len(plus) or len(minus)):
            which, score = np.arange(n), np.zeros(n, exact.dtype)
        which, score = at_least_kth(which, score, k)
        out.append((which, score.astype(np.int64)))
    return out


def nearest_by_collisions(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", projections: int = 16, share: float = 0.5, sure: float = 0.95, first: float = 0.6, widen: float = 1.3, seed: int = 11, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score (double): about the k rows of largest inner product for each query.

    sure is the probability with which each true neighbour is verified. Vectors that are null, empty, zero, or hold
    null or non-finite components take no part, nor do rows without id. Only vectors of the query's length are its
    candidates, and no row of its own id is; rows that repeat an id or a vector count each. With fewer candidates than k all are returned. Other columns are ignored; an empty table gives no rows.
    """
    rows = usable(vectors, id_col, vec_col, False, lambda x: x)
    return search_blocks(rows, is_query(F.col("__id")), k, collision_search(projections, share, sure, first, widen, seed), "double", block_rows, chunk_rows)


def exact_top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score (long): exactly the k rows of largest inner product of floor(scale * x).

    Vectors that are null, empty, or hold null or non-finite components take no part; zero vectors do. As to the rest,
    see nearest_by_collisions. A score that doesn't fit a long is an error.
    """
    rows = usable(vectors, id_col, vec_col, True, lambda x: F.floor(x * F.lit(scale)).cast("double"))
    return search_blocks(rows, is_query(F.col("__id")), k, threshold_search, "long", block_rows, chunk_rows)
