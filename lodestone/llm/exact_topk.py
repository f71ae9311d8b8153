"""Exact top-k search, block at a time.

Components, as whole numbers, are the impacts of as many terms. Vectors in the order
of their ids are cut into tiles by ranges of ids and those into blocks, each with every
term's largest and smallest impact and a forward index, block by block. A query sums,
over its terms, the most that a block's range can give it, visits blocks by falling
sums, scores whole blocks, and stops where a sum is below its k-th score; the k-th score
of one tile is known to all others from the start.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.grid import nearest, top

BEST = 10
EVERY = 100
BLOCK = 128
SCALE = 1024
LONG = (-(1 << 63), (1 << 63) - 1)


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x), as doubles where those are whole numbers exactly; infinite where a double cannot hold it."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * x)


def arithmetic(a: np.ndarray, b: np.ndarray) -> type:
    """A type in which inner products of rows of a and b are exact: doubles if they stay below 2**53, else Python's integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float64 if most < 2**53 else object


def integers(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as Python's integers; from 2**43 on a double is a multiple of 1/1024."""
    return np.array([[SCALE * int(v) if abs(v) >= 2**53 else int(np.floor(SCALE * v)) for v in r] for r in x], object).reshape(x.shape)


def held(score: int) -> int:
    """A score at the ends of a long, where it is beyond them."""
    return min(max(int(score), LONG[0]), LONG[1])


class Blocks:
    """A forward index of candidates in the order of their ids, with each block's range of impacts."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.starts = np.arange(0, len(ids), BLOCK)
        self.high, self.low = np.maximum.reduceat(vectors, self.starts, axis=0), np.minimum.reduceat(vectors, self.starts, axis=0)
        self.forward = [(vectors[a : a + BLOCK], ids[a : a + BLOCK]) for a in self.starts]

    def best(self, query: np.ndarray, least: int | None, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and scores of the k best that are at least ``least``, and how many blocks were scored."""
        bounds = self.high.dot(np.maximum(query, 0)) + self.low.dot(np.minimum(query, 0))
        best_s, best_id, scored = np.zeros(0, query.dtype), np.zeros(0, np.int64), 0
        for b in np.argsort(-bounds, kind="stable"):
            if least is not None and bounds[b] < least:
                break
            scored += 1
            vectors, own = self.forward[b]
            s = vectors.dot(query)
            keep = s >= least if least is not None else np.ones(len(s), bool)
            s, own = np.concatenate((best_s, s[keep])), np.concatenate((best_id, own[keep]))
            at = top(np.zeros(len(s), np.int64), own, s, k)
            best_s, best_id = s[at], own[at]
            if len(at) == k:
                least = best_s[-1] if least is None else max(least, best_s[-1])
        return best_id, best_s, scored


def tile_best(queries: np.ndarray, least: list, vectors: np.ndarray, ids: np.ndarray, k: int):
    """A tile's k best of each query: number, id and score."""
    a, b = whole(queries), whole(vectors)
    if arithmetic(a, b) is object:
        a, b = integers(queries), integers(vectors)
    blocks, out_q, out_id, out_s = Blocks(b, ids), [], [np.zeros(0, np.int64)], []
    for q in range(len(a)):
        # A score at a long's end may be less than it was.
        known = least[q] if least[q] is not None and LONG[0] < least[q] < LONG[1] else None
        found, scores, _ = blocks.best(a[q], known, k)
        out_q += [q] * len(found)
        out_id.append(found)
        out_s += map(held, scores)
    return np.array(out_q, np.int64), np.concatenate(out_id), np.array(out_s, np.int64)


def own_scores(x: np.ndarray) -> np.ndarray:
    a = whole(x)
    a = integers(x) if arithmetic(a, a) is object else a
    return np.array([held(r.dot(r)) for r in a], np.int64)


tile_best.own = own_scores


def top_scores(vectors: DataFrame, k: int = BEST, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id and score (whole) of vectors (vec_id, embedding).

    Other columns are ignored. Rows without an id and vectors that are null or hold a
    null or a non-finite component take no part. Ties go to the smaller vec_id.
    Scores beyond a long are held at its ends. Rows of one vec_id are queries and
    candidates of their own.
    """
    return nearest(vectors, every, k, tile_best, zero=True, exact=True)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest scores of every 100th vector."""
    return top_scores(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP8_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
pairs AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.rid <> c.rid AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 10
"""
