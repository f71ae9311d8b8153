"""A stated query set against all vectors, in tiles of a grid.

Candidates are cut into tiles by ranges of their ids and queries are dealt into tiles;
each tile of one meets each of the other in a task of its own, which returns its
queries' nearest. A query's nearest of all tiles are merged by a heap of k.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes and rows of a tile as doubles, and the least number of candidate tiles, so that small tables use many cores too.
TILE_BYTES = 64 << 20
TILE_ROWS = 65536
LEAST_TILES = 8
KEY = ["query_id", "query_hash"]


def usable(zero: bool) -> Column:
    """Vectors with an id and only finite components; zero vectors where asked for."""
    x = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
    return ok if zero else ok & F.exists(x, lambda v: v != 0)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long lists as doubles."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _merged(k: int, exact: bool):
    """A heap of k + 1 for one query at a time; its own row goes, and the query comes as often as its row."""

    def rows(q: int, times: int, own: float, heap: list[tuple]) -> list[tuple]:
        best = [(q, -v, s) for s, v in sorted(heap, reverse=True)]
        if (q, q, own) in best:
            best.remove((q, q, own))
        return [(q, r, v, s) for r, (_, v, s) in enumerate(best[:k], 1)] * times

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heap = None, []
        for b in batches:
            out = []
            for q, h, times, own, v, s in zip(*(b.column(c).to_pylist() for c in (*KEY, "times", "own", "vec_id", "score")), strict=True):
                if (q, h) != (at and at[:2]):
                    if at:
                        out += rows(at[0], *at[2:], heap)
                    at, heap = (q, h, times, own), []
                if len(heap) <= k:
                    heapq.heappush(heap, (s, -v))
                elif (s, -v) > heap[0]:
                    heapq.heapreplace(heap, (s, -v))
            yield _table(out)
        yield _table(rows(at[0], *at[2:], heap) if at else [])

    def _table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64() if exact else pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "rank", "vec_id", "score"])

    return merge


def top(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Of pairs (query number, candidate id, score), the places of each query's k best."""
    order = np.lexsort((ids, -scores if scores.dtype != object else np.array([-s for s in scores], object), q))
    starts = np.flatnonzero(np.concatenate(([True], q[order][1:] != q[order][:-1]))) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(order)]))))
    return order[rank < k]


def range_tiles(known: DataFrame, tiles: int, tile_rows: int) -> tuple[Column, int]:
    """A column that numbers tiles by ranges of vec_id, and how many there are; a range of too many equal ids is dealt over several by hash."""
    cuts = sorted(set(known.stat.approxQuantile("vec_id", [i / tiles for i in range(1, tiles)], 0.001))) if tiles > 1 else []
    # Two short lists are searched in place of a long one.
    step = max(1, int(len(cuts) ** 0.5))
    lists = [cuts[i : i + step] for i in range(0, len(cuts), step)] or [[]]
    below = lambda xs: F.size(F.filter(xs, lambda c: c <= F.col("vec_id")))
    number = lambda xs: F.array(*(F.lit(float(x)) for x in xs)).cast("array<double>")
    group = below(number([x[0] for x in lists[1:]]))
    tile = group * step + below(F.get(F.array(*map(number, lists)), group))
    counts = {r[0]: r[1] for r in known.groupBy(tile).count().collect()}  # one number for each tile
    parts = [max(1, -(-counts.get(i, 0) // tile_rows)) for i in range(len(cuts) + 1)]
    first = np.cumsum([0, *parts]).tolist()
    listed = lambda xs: F.array(*map(F.lit, xs))
    return F.get(listed(first), tile) + F.pmod(F.xxhash64("embedding"), F.get(listed(parts), tile)).cast("int"), first[-1]


def nearest(vectors: DataFrame, every: int, k: int, score: Callable, *, zero: bool, exact: bool, tile_rows: int | None = None, least_tiles: int = LEAST_TILES) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of all rows for each row whose vec_id is divisible by ``every``.

    ``score(queries, least, candidates, ids, k)`` returns a tile's k best as arrays
    (query number, id, score), ids by rising value; it may leave out what scores below
    ``least``. Vectors meet those of their own length only. Every row is a candidate
    for every query but the one that is the query itself; rows of equal ids are rows of
    their own, and so are queries. With ``exact`` a query's k-th score of one tile is
    known to all others.
    """
    known = vectors.where(usable(zero)).select("vec_id", "embedding", F.size("embedding").alias("dim"))
    is_query = F.col("vec_id") % every == 0
    n, asked, dim = known.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max("dim")).first()
    tile_rows = tile_rows or max(256, min(TILE_ROWS, TILE_BYTES // (8 * max(1, dim or 1))))
    rows = max(1, -(-asked // tile_rows))
    column, columns = range_tiles(known, max(least_tiles, -(-n // tile_rows)), tile_rows)
    number = "long" if exact else "double"
    # Equal query rows have equal answers.
    queries = known.where(is_query).groupBy("vec_id", "embedding", "dim").agg(F.count("*").alias("times")).select(*(F.col(c).alias(c) for c in ("vec_id", "embedding", "dim", "times"))).withColumn("query_hash", F.xxhash64("embedding")).withColumn("row", F.pmod("query_hash", F.lit(rows)).cast("int"))
    candidates = known.withColumn("column", column)
    keys = ["dim", "row", "column"]
    numbers = lambda m, start=0: F.explode(F.sequence(F.lit(start), F.lit(m - 1)))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        parts, of = [np.zeros(0, np.int64), np.zeros(0)], np.zeros(0, np.int64)
        own = np.zeros(0, np.int64 if exact else float)
        if a.num_rows and b.num_rows:
            b = b.sort_by("vec_id")
            ids, x = b["vec_id"].to_numpy(), matrix(a["embedding"])
            of, *parts = score(x, a["least"].to_pylist(), matrix(b["embedding"]), ids, k + 1)
            own = score.own(x)
        take = lambda c: a[c].take(pa.array(of)) if a.num_rows else pa.array([], pa.int64())
        return pa.table({"query_id": take("vec_id"), "query_hash": take("query_hash"), "times": take("times"), "own": pa.array(own[of] if len(of) else own[:0], pa.int64() if exact else pa.float64()), "vec_id": pa.array(parts[0], pa.int64()), "score": pa.array(parts[1], pa.int64() if exact else pa.float64())})

    def met(asks: DataFrame, among: DataFrame) -> DataFrame:
        return asks.groupBy(*keys).cogroup(among.groupBy(*keys)).applyInArrow(meet, f"query_id long, query_hash long, times long, own {number}, vec_id long, score {number}")

    if exact and columns > 1:
        first = met(queries.withColumn("column", F.lit(0)).withColumn("least", F.lit(None).cast(number)), candidates.where(F.col("column") == 0).withColumn("row", numbers(rows)))
        # The k-th score but for the query's own row: at least that of the (k + 1)-th.
        known_least = first.groupBy(F.col("query_id").alias("vec_id"), "query_hash").agg(F.when(F.count("*") > k, F.min("score")).alias("least"))
        queries = queries.join(known_least, ["vec_id", "query_hash"], "left")
    else:
        queries = queries.withColumn("least", F.lit(None).cast(number))
    best = met(queries.withColumn("column", numbers(columns)), candidates.withColumn("row", numbers(rows)))
    return best.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_merged(k, exact), f"query_id long, rank int, vec_id long, score {number}")
