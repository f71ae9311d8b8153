"""Nearest neighbours by a block matrix join of int8 tiles with error bounds.

Vectors are rounded to 8 bits. Products of the rounded ones come from one matrix
product to a tile and are exact; with the norms of what rounding left out they bound
the true inner product from both sides. Pairs whose upper bound reaches the k-th best
lower bound survive and are computed again from the vectors as they are. No pair is
dropped that could be among the k best, so recall is 1.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.grid import nearest, top

NEIGHBOURS = 20
EVERY = 20
#: Products of a tile that are held at once.
HELD = 4 << 20
#: Survivors that are computed at once.
PAIRS = 1 << 16
#: Dimensions over which float32 sums of int8 products are exact.
EXACT = 1024
#: Components from which on products are not taken in doubles alone.
HUGE = 1e100


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, norms of what they stand for and norms of what is left out."""
    scale = np.abs(x).max(1) / 127
    scale = np.where(scale > 0, scale, 1)
    q = np.rint(x / scale[:, None])
    stand = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(stand, axis=1), np.linalg.norm(x - stand, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of int8 rows, exact."""
    out = 0
    for d in range(0, a.shape[1], EXACT):
        out = out + (a[:, d : d + EXACT].astype(np.float32) @ b[:, d : d + EXACT].astype(np.float32).T).astype(np.float64)
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, summed from the first dimension to the last; in a wider range where doubles might overflow on the way."""
    wide = a.size and b.size and float(np.abs(a).max()) > HUGE or b.size and float(np.abs(b).max()) > HUGE
    out = np.zeros(len(a), np.longdouble if wide else np.float64)
    for d in range(a.shape[1]):
        out += a[:, d].astype(out.dtype) * b[:, d]
    with np.errstate(over="ignore"):
        return out.astype(np.float64)


def tile_best(queries: np.ndarray, least: list, vectors: np.ndarray, ids: np.ndarray, k: int):
    """A tile's k best of each query: number, id and score. Vectors with huge components are not rounded and always survive."""
    huge, asks_huge = np.abs(vectors).max(1) > HUGE, np.abs(queries).max(1) > HUGE
    (qa, sa, na, ra), (qb, sb, nb, rb) = rounded(np.where(asks_huge[:, None], 0, queries)), rounded(np.where(huge[:, None], 0, vectors))
    full = np.linalg.norm(np.where(huge[:, None], 0, vectors), axis=1)
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, HELD // len(ids))
    for i in range(0, len(queries), step):
        j = slice(i, i + step)
        near = products(qa[j], qb) * sa[j, None] * sb[None, :]
        bound = (na[j, None] * rb[None, :] + ra[j, None] * full[None, :]) * (1 + 1e-9) + 1e-12 * (na[j, None] + ra[j, None]) * full[None, :]
        survive = np.ones_like(near, bool)
        if len(ids) > k:
            lower = np.where(huge[None, :], -np.inf, near - bound)
            kth = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k]
            survive = (near + bound >= kth[:, None]) | huge[None, :] | asks_huge[j, None]
        # Survivors are computed before the next queries are bounded, and so many at once.
        of, c = np.nonzero(survive)
        for p in range(0, len(of), PAIRS):
            q, other = of[p : p + PAIRS] + i, c[p : p + PAIRS]
            s = inner(queries[q], vectors[other])
            best = top(q, ids[other], s, k)
            parts.append((q[best], ids[other][best], s[best]))
    q, c, s = (np.concatenate(x) for x in zip(*parts, strict=True))
    best = top(q, c, s, k)
    return q[best], c[best], s[best]


tile_best.own = lambda x: inner(x, x)


def neighbours(vectors: DataFrame, k: int = NEIGHBOURS, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id and score (double inner product) of vectors (vec_id, embedding).

    Other columns are ignored. Rows without an id and vectors that are null, zero or
    hold a null or a non-finite component take no part. Ties go to the smaller vec_id.
    Rows of one vec_id are queries and candidates of their own; a product beyond the
    range of doubles is infinite.
    """
    return nearest(vectors, every, k, tile_best, zero=False, exact=False)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP4_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
pairs AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score FROM v q JOIN v c ON q.rid <> c.rid AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 20
"""
