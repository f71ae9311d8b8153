"""SimHash near-duplicates: bit-sliced comparison inside pigeonhole buckets.

Fingerprints that differ in at most ``radius`` bits agree on two of ``radius + 2``
bands, so every link lies in a bucket keyed by a pair of equal bands. A bucket's
fingerprints are stored vertically, 64 to a block and one word to a bit plane; a
probe updates its distances to a whole block with carry-save counters and leaves
the block when all of them exceed the radius. A bucket passes on a spanning forest
of its links, never its pairs; components of the forests are found with
large-star/small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.staging import staged, unstaged

SEED = 42
RADIUS = 4
SHINGLE = 4
#: Rows of a bucket that one task compares with as many others; larger buckets are tiled.
TILE_ROWS = 16384
#: Probe and block pairs that are compared at once.
SLAB = 65536
#: Neighbours of a vertex from which on it is sent to all tasks instead of its neighbours to one.
STAR_ROWS = 4096
#: Edges, 16 bytes each, that the driver takes to finish a graph instead of rounds over the cluster.
GATHERED = 1 << 16
#: Rows that a worker reads at once.
ROWS = 512
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text; zero without words."""
    words = text.lower().split() if text else []  # ASCII letters and ASCII white space only
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x.slice(i, ROWS) for x in batches for i in range(0, x.num_rows, ROWS)):
        texts = b.column("text").cast(pa.binary())
        found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(found.view(np.int64))], ["doc_id", "digest", "fp"])


class Forest:
    """Vectorised union by smallest label."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                nearer = self.label[self.label]
                if np.array_equal(nearer, self.label):
                    break
                self.label = nearer


def sliced_forest(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS, slab: int = SLAB) -> np.ndarray:
    """For each row, the row that stands for all it is linked to within its key.

    ``keys`` are sorted; ``fps`` are unsigned. Rows of one key link at ``radius`` or
    fewer differing bits.
    """
    n = len(keys)
    forest = Forest(n)
    if n < 2:
        return forest.label
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((first, [n])))
    place = np.arange(n) - np.repeat(first, sizes)
    lane = (place % 64).astype(np.uint64)
    heads = np.flatnonzero(lane == 0)  # the first row of each block
    block = np.cumsum(lane == 0) - 1
    last = np.repeat(block[first + sizes - 1], sizes)
    planes = [np.bitwise_or.reduceat(((fps >> np.uint64(b)) & np.uint64(1)) << lane, heads) for b in range(64)]
    held = np.bitwise_or.reduceat(np.uint64(1) << lane, heads)
    counters = max(1, radius.bit_length())
    rows = np.flatnonzero(np.repeat(sizes > 1, sizes))
    tasks = np.cumsum(last[rows] - block[rows] + 1)
    at = 0
    while at < len(rows):
        done = tasks[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(tasks, done + slab, "right")))
        own = rows[at:to]
        each = last[own] - block[own] + 1
        probe = np.repeat(own, each)
        other = np.repeat(block[own], each) + np.arange(len(probe)) - np.repeat(np.cumsum(each) - each, each)
        at = to
        # In its own block a probe meets only the lanes after it.
        open_ = np.where(other == block[probe], held[other] & ~((np.uint64(2) << lane[probe]) - np.uint64(1)), held[other])
        count = [np.zeros(len(probe), np.uint64) for _ in range(counters)]
        over = np.zeros(len(probe), np.uint64)
        own_fp = fps[probe]
        for b in range(0, 64, 2):
            x, y = (planes[b + j][other] ^ (-((own_fp >> np.uint64(b + j)) & np.uint64(1)).astype(np.int64)).view(np.uint64) for j in (0, 1))
            half = x ^ y
            carry = (x & y) | (count[0] & half)
            count[0] = count[0] ^ half
            for k in range(1, counters):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if b % 4 == 2 and b >= 6 or b == 62:
                near = open_ & ~(over | _exceeds(count, radius))
                stay = near != 0
                if not stay.all():
                    probe, other, open_, over, own_fp, near = (v[stay] for v in (probe, other, open_, over, own_fp, near))
                    count = [v[stay] for v in count]
                if not len(probe):
                    break
        else:
            bits = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            task, at_lane = np.nonzero(bits)
            forest.union(probe[task], heads[other[task]] + at_lane)
    return forest.label


def _exceeds(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above ``radius``, compared bit by bit from the top."""
    above, equal = np.zeros_like(count[0]), np.full_like(count[0], ONES)
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            equal &= count[k]
        else:
            above |= equal & count[k]
            equal &= ~count[k]
    return above


def _links(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def made(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            tables = [np.concatenate(x) for x in zip(*held, strict=True)]
            key = np.cumsum(np.concatenate(([0], (tables[0][1:] != tables[0][:-1]) | (tables[1][1:] != tables[1][:-1]))))
            whole = len(key) if last else int(np.searchsorted(key, key[-1]))
            held, rows = ([tuple(x[whole:] for x in tables)] if whole < len(key) else []), len(key) - whole
            fps = tables[2][:whole].view(np.uint64)
            root = sliced_forest(key[:whole], fps, radius)
            tied = np.flatnonzero(root != np.arange(whole))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(tables[2][tied]), pa.array(tables[2][root[tied]])], ["u", "v"])

        for b in batches:
            if b.num_rows:
                held.append(tuple(b.column(c).to_numpy() for c in ("key", "tile", "fp")))
                rows += b.num_rows
            if rows >= 1 << 18:
                yield from made(last=False)
        if held:
            yield from made(last=True)

    return link


def band_keys(fp, radius: int) -> list:
    """Columns that are equal in one place at least for fingerprints within ``radius``."""
    n = radius + 2
    cuts = [round(64 * i / n) for i in range(n + 1)]
    bands = [F.shiftrightunsigned(fp, a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [(F.lit(k) * F.lit(1 << 48) + bands[i] * F.lit(1 << 24) + bands[j]).alias(f"k{k}") for k, (i, j) in enumerate(combinations(range(n), 2))]


def links(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (u, v) that connect all of ``fps`` (fp long, distinct) within ``radius``.

    Rows: at most one for each fingerprint and tile of a bucket; a link may come from
    several. Buckets over ``tile_rows``, of which there are at most as many as bands'
    pairs for ``tile_rows`` fingerprints, are broadcast and dealt into tiles, and each
    two tiles meet in a task of their own.
    """
    keyed = fps.select("fp", F.explode(F.array(*band_keys(F.col("fp"), radius))).alias("key"))
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile_rows).select("key", F.ceil(F.col("n") / tile_rows).alias("tiles"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    # Tiles i <= j meet under the number i * tiles + j; a row of tile a is sent to each meeting of a.
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda x: F.least(x, own) * F.col("tiles") + F.greatest(x, own))
    tiled = keyed.join(F.broadcast(large), "key", "left").select("key", "fp", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0).cast("long"))).otherwise(meets)).alias("tile"))
    return tiled.repartition("key", "tile").sortWithinPartitions("key", "tile", "fp").mapInArrow(_links(radius), "u long, v long")


def _spread(edges: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """Edges (u, v) with m of ``least`` (u, m, n): n edges, ``most`` at the most, of one u meet in a task only where they are few."""
    if most <= STAR_ROWS:
        return edges.join(least.select("u", "m"), "u")
    many = F.col("n") > STAR_ROWS
    hot = F.broadcast(least.where(many).select("u", "m"))
    return edges.join(hot, "u").unionByName(edges.join(hot.select("u"), "u", "left_anti").join(least.where(~many).select("u", "m"), "u"))


def _gathered(edges: DataFrame) -> DataFrame:
    """components() of few edges, found by the driver."""
    u, v = (c.to_numpy() for c in edges.select("u", "v").toArrow().columns)
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    forest = Forest(len(ids))
    forest.union(at[: len(u)], at[len(u) :])
    tied = np.flatnonzero(forest.label != np.arange(len(ids)))
    return staged(edges.sparkSession.createDataFrame(pa.table({"u": ids[tied], "v": ids[forest.label[tied]]}), edges.schema), "roots")


def components(edges: DataFrame, gathered: int = 0) -> DataFrame:
    """The smallest member (v) that each vertex (u) of ``edges`` (u, v) reaches; roots themselves have no row.

    A middle of very many neighbours would bring them all to one task; such middles,
    of which there are at most one for ``STAR_ROWS`` edges, are broadcast. Each round stars every vertex's larger neighbours, then its smaller ones, around
    the smallest; both halves of a round and their least neighbours are staged, as an edge
    names them several times and the plan of two in one would be their product. Rounds
    end when every vertex with a smaller neighbour has no other one, or when no more
    than ``gathered`` edges are left, which the driver joins by itself.
    """
    stars = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    while True:
        if gathered and stars.count() <= gathered:
            roots = _gathered(stars)
            unstaged(stars)
            return roots
        both = stars.select("u", "v", F.lit(0).alias("larger")).unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(1).alias("larger")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m"), F.sum("larger").alias("n"), F.count("*").alias("all")).select("u", F.least("u", "m").alias("m"), "n", (F.col("all") > 1).alias("more")), "least")
        at = least.agg(F.max((F.col("m") < F.col("u")) & F.col("more")).alias("open"), F.max("n").alias("n")).first()
        if not at.open:
            unstaged(least)
            return stars
        # One row for each edge, so nothing grows before rows are told apart again.
        large = staged(_spread(stars.select(F.col("v").alias("u"), F.col("u").alias("v")), least, at.n).select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        lower = staged(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"), (F.max("v") > F.min("v")).alias("more")), "least")
        most = lower.where("more").agg(F.max("n")).first()[0] or 0
        small = _spread(large, lower.where("more"), most).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, stars = stars, staged(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "stars")
        unstaged(before, least, large, lower)


def _rooted(docs: DataFrame, radius: int) -> DataFrame:
    """simhash_groups with each component's root fingerprint, which no other component has."""
    marked = staged(docs.select(F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("digest"), F.col("text")).mapInArrow(_fingerprints, "doc_id long, digest string, fp long"), "fingerprints")
    fps = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(links(fps, radius), GATHERED)
    homed = fps.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("v", "fp").alias("root"))
    named = homed.join(homed.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "component_id", "root")
    return marked.join(named, "fp").select("doc_id", "digest", "fp", "component_id", "root")


def simhash_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Every row's doc_id, text digest, fingerprint and component.

    Args: docs with doc_id and text; other columns are ignored. A null or blank text
    has fingerprint zero, which links like any other. Repeated rows each get a row.
    A null doc_id is never a component's smallest, unless it has no other.
    Returns doc_id, digest (of the text), fp (signed), component_id.
    """
    return _rooted(docs, radius).drop("root")


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents with one row for each component: its smallest doc_id (a null last), then the smallest digest of its text."""
    groups = _rooted(docs, radius)
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("digest"))).alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.digest").alias("kept_digest"))
    marked = docs.withColumn("__digest", F.md5(F.coalesce(F.col("text"), F.lit(""))))
    one = marked.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("__digest") == F.col("kept_digest")), "left_semi")
    return one.dropDuplicates(["doc_id", "__digest"]).drop("__digest")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    groups = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return groups.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
