"""Exact top-k inner products with multi-resolution segment statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buildlens.session import cut_lineage

COARSE = (4, 16)
TILE = 2048
PAIRS = 1 << 18
BLOCK_VALUES = 1 << 21


def _stats(v: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length."""
    parts = np.array_split(np.arange(v.shape[1]), segments)
    mean = [v[:, p].mean(axis=1) * np.sqrt(len(p)) for p in parts]
    dev = [v[:, p].std(axis=1) * np.sqrt(len(p)) for p in parts]
    return np.stack(mean + dev, axis=1)


def _levels(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine; the finest segments have two components."""
    return sorted({min(n, dim) for n in (*COARSE, dim // 2) if n and dim})


def _number_type(q: np.ndarray, c: np.ndarray) -> type:
    """The cheapest type in which every inner product of these rows is exact."""
    largest = [max((abs(int(x)) for x in (m.min(initial=0), m.max(initial=0))), default=0) for m in (q, c)]
    reach = largest[0] * largest[1] * q.shape[1]
    for top, kind in ((1 << 24, np.float32), (1 << 53, np.float64), (1 << 63, np.int64)):
        if reach < top:
            return kind
    return object


def _as_long(s: np.ndarray) -> np.ndarray:
    """Whole numbers as longs; beyond 64 bits they stop at the ends."""
    if s.dtype == object:
        ends = np.iinfo(np.int64)
        return np.array([min(max(x, ends.min), ends.max) for x in s], np.int64)
    return s.astype(np.int64)


def _fits(fq: np.ndarray, fc: np.ndarray, limit: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The pairs of ``mask`` whose greatest possible product reaches their query's limit."""
    if np.count_nonzero(mask) * 16 > mask.size:
        return mask & (fq @ fc.T >= limit[:, None])
    out = np.zeros_like(mask)
    rows, cols = np.nonzero(mask)
    for at in range(0, len(rows), PAIRS):
        r, j = rows[at : at + PAIRS], cols[at : at + PAIRS]
        out[r, j] = np.einsum("ij,ij->i", fq[r], fc[j]) >= limit[r]
    return out


def block_top(
    q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score): each query's k best of a block of candidates.

    With means m and deviations s of segments of length L, the squared distance is at least
    sum L ((m - m')^2 + (s - s')^2), and the inner product is (|q|^2 + |c|^2 - distance^2) / 2,
    so it is at most sum L (m m' + s s'). Pairs that stay below the query's k-th score so far go,
    first by wide segments, then by narrow ones; only the rest are multiplied out.
    """
    n_q, dim = q.shape
    kind = _number_type(q, c)
    # The longest candidates first: they tend to set high thresholds early.
    order = np.argsort(-(c.astype(float) ** 2).sum(axis=1), kind="stable")
    c_ids, c = c_ids[order], c[order]
    qf, cf = q.astype(float), c.astype(float)
    slack = 1e-6 + 1e-9 * sum((x * x).sum(axis=1).max(initial=0) for x in (qf, cf))
    levels = [(_stats(qf, s), _stats(cf, s)) for s in _levels(dim)]
    q, c = q.astype(kind), c.astype(kind)
    best_s = np.full((n_q, k), np.iinfo(np.int64).min)
    best_id = np.full((n_q, k), np.iinfo(np.int64).max)
    floor = np.full(n_q, np.iinfo(np.int64).min)
    limit = np.full(n_q, -np.inf)
    filled = np.zeros(n_q, np.int64)
    lo, width = 0, min(TILE, 256)
    while lo < len(c):
        hi = min(lo + width, len(c))
        mask = q_ids[:, None] != c_ids[None, lo:hi]
        for fq, fc in levels:
            mask = _fits(fq, fc[lo:hi], limit, mask)
        found = []
        for row in np.flatnonzero(mask.any(axis=1)):
            at = lo + np.flatnonzero(mask[row])
            s = _as_long(c[at] @ q[row])
            good = s >= floor[row]
            found.append((np.full(np.count_nonzero(good), row), at[good], s[good]))
        # Small tiles first, while thresholds are low.
        lo, width = hi, min(2 * width, TILE)
        if not found:
            continue
        r, j, s = map(np.concatenate, zip(*found))
        # Merge with the best so far: by query, then score down, then id.
        have = np.flatnonzero(filled)
        old_r = np.repeat(have, filled[have])
        old_at = np.arange(len(old_r)) - np.repeat(np.cumsum(filled[have]) - filled[have], filled[have])
        r = np.concatenate([old_r, r])
        s = np.concatenate([best_s[old_r, old_at], s])
        ids = np.concatenate([best_id[old_r, old_at], c_ids[j]])
        by = np.lexsort((ids, ~s, r))
        r, s, ids = r[by], s[by], ids[by]
        first = np.searchsorted(r, np.arange(n_q))
        place = np.arange(len(r)) - first[r]
        keep = place < k
        r, s, ids, place = r[keep], s[keep], ids[keep], place[keep]
        best_s[r, place], best_id[r, place] = s, ids
        filled = np.bincount(r, minlength=n_q)
        full = filled >= k
        floor[full] = best_s[full, k - 1]
        limit[full] = floor[full].astype(float) - slack
    r = np.repeat(np.arange(n_q), filled)
    at = np.arange(len(r)) - np.repeat(np.cumsum(filled) - filled, filled)
    return r, best_id[r, at], best_s[r, at]


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    flat = table.column(name).combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0) if flat.num_chunks else pa.array([], pa.list_(pa.int64()))
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, -1)


def exact_top_k(
    vectors: DataFrame, k: int = 20, every: int = 20, query_block: int = 2048, candidate_block: int = 16384
) -> DataFrame:
    """(query_id, rank, vec_id, score) from (vec_id, embedding): k best inner products per query.

    Components become floor(64 x). Queries are the rows whose vec_id is divisible by ``every``;
    candidates are all rows with another vec_id. Ties go to the smaller vec_id. Rows with a null
    id, a null vector or a null or non-finite component take no part; only vectors of the same
    length are compared; vectors without components score 0. Repeated rows are candidates of their
    own and, as queries, one query, with the smallest of their vectors if these differ. Scores beyond a long stop at its ends. Other columns aren't
    read. An empty table gives an empty result.

    Blocks of queries meet blocks of candidates, a bounded number of rows and of components in a
    task at any size; each pair of blocks returns k rows per query, which one window per query merges.
    """
    e = F.col("embedding")
    bad = F.exists(
        e,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))),
    )
    whole = cut_lineage(
        vectors.filter(F.col("vec_id").isNotNull() & e.isNotNull()).filter(~bad).select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.transform(e, lambda x: F.floor(x.cast("double") * 64).cast("long")).alias("v"),
        )
    )
    queries = whole.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_q = queries.count()
    n_c, widest = whole.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    room = max(1, BLOCK_VALUES // max(1, widest or 0))
    query_block, candidate_block = min(query_block, room), min(candidate_block, room)
    q_blocks, c_blocks = max(1, -(-n_q // query_block)), max(1, -(-n_c // candidate_block))
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every_c = F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))
    every_q = F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    # Candidates are dealt by their rows' places too, so that a repeated id fills no block.
    place = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(c_blocks)).cast("int")
    left = queries.select(spread(q_blocks).alias("qb"), every_c.alias("cb"), F.size("v").alias("dim"), "vec_id", "v")
    right = whole.withColumn("cb", place).select(
        every_q.alias("qb"), "cb", F.size("v").alias("dim"), "vec_id", "v"
    )

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        r, ids, scores = (np.zeros(0, np.int64),) * 3
        q_ids = q.column("vec_id").to_numpy()
        if q.num_rows and c.num_rows:
            r, ids, scores = block_top(
                q_ids, _matrix(q, "v"), c.column("vec_id").to_numpy(), _matrix(c, "v"), k
            )
        return pa.table(
            {"query_id": pa.array(q_ids[r], pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())}
        )

    keys = ["qb", "cb", "dim"]
    some = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        run, "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
