"""Toxicity by class-conditional Kneser-Ney models of words' letters.

Two models, of toxic and of ordinary documents, spell a word letter by letter. Both
discount their own counts and back off to one shared model of both classes, so an
expression that is rare in either is judged by what its parts are known for. A word's
evidence is the difference of its two log-likelihoods as far as it exceeds a margin;
a text's is the sum of its words' over a power of their number, and a logistic curve of
that one figure, fitted on labelled documents that the counts have not seen, is the
score.

Fitted on a bounded sample of labelled rows: at most ``SAMPLE`` documents of each
class, those whose hashed doc_id is smallest.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.staging import staged, unstaged

SAMPLE = 6000
#: Letters of the longest n-gram that is counted, and below how many of them classes do not differ.
ORDER = 6
SHARED = 3
DISCOUNT = 0.9
#: Counts that the shared model weighs in each context of a class.
STRENGTH = 200.0
START, END = "\x02", "\x03"
#: Nats by which a word's toxic log-likelihood must exceed the ordinary one to count, and the power of the number of words that a text's sum is divided by.
MARGIN = 1.0
POWER = 0.75
THRESHOLD = 0.3
#: Letters of the words whose evidence a worker keeps (a full cache is dropped), and of the longest word that is kept.
CACHE, LONG = 1_000_000, 100
WORDS = re.compile(r"\w+")
#: Texts whose unseen words are read together, and distinct words that are counted together.
TEXTS, KINDS = 64, 50_000
#: Rows that a worker reads at once.
ROWS = 512
#: Slices, a power of two, in which the driver fetches the n-grams.
SLICES = 16
#: An n-gram is known by a 64-bit polynomial of its letters' hashes; the factor is odd, so an end can be taken off.
FACTOR = 0x9E3779B97F4A7C13
COLUMNS = ["gram", "prefix", "suffix", "letters", "ordinary", "toxic"]


def grams(word: str, order: int = ORDER) -> Iterator[str]:
    """Every n-gram of a word between its marks, up to ``order`` letters."""
    w = f"{START}{word}{END}"
    for i in range(2, len(w) + 1):
        for n in range(1, min(order, i) + 1):
            if i - n > 0 or n > 1:
                yield w[i - n : i]


def _codes(points: np.ndarray) -> np.ndarray:
    """A hash of each code point."""
    x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


class Spelt:
    """Words between their marks, one after another, and the hashes of their n-grams by the place they end at."""

    def __init__(self, words: list[str]):
        marked = [f"{START}{w}{END}" for w in words]
        sizes = np.fromiter(map(len, marked), np.int64, len(words))
        self.word = np.repeat(np.arange(len(words)), sizes)
        #: How many letters of its word there are up to each place.
        self.upto = np.arange(len(self.word)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        self.code = _codes(np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32))

    def hashes(self, order: int) -> Iterator[tuple[int, np.ndarray]]:
        """For n from 1 to ``order``, the hash of the n letters up to each place; it means nothing where a word has fewer."""
        found, power = np.zeros(len(self.code), np.uint64), np.uint64(1)
        for n in range(1, order + 1):
            if n <= len(self.code):
                found = found.copy()
                found[n - 1 :] += self.code[: len(self.code) - n + 1] * power
            yield n, found
            power = np.uint64(int(power) * FACTOR % 2**64)


def counted(words: dict[str, tuple[int, int]], order: int) -> list[np.ndarray]:
    """Columns of all n-grams of words with their numbers in both classes: hash, hash without the last and without the first letter, letters (negative from a word's start on) and both numbers.

    Those of ``grams``; one row for each n-gram.
    """
    spelt, parts = Spelt(list(words)), []
    numbers = np.array(list(words.values()), np.int64).reshape(-1, 2)
    before = np.zeros(len(spelt.code), np.uint64)
    for n, own in spelt.hashes(order):
        at = np.flatnonzero((spelt.upto >= n) & (spelt.upto > 1))
        _, first, group = np.unique(own[at], return_index=True, return_inverse=True)
        one = at[first]
        prefix = before[one - 1] if n > 1 else np.zeros(len(one), np.uint64)
        both = [np.bincount(group, numbers[spelt.word[at], c], len(one)).astype(np.int64) for c in (0, 1)]
        parts.append((own[one], prefix, before[one], np.where(spelt.upto[one] == n, -n, n), *both))
        before = own
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _listed(counts: dict[str, tuple[int, int]]) -> list[np.ndarray]:
    """The columns of ``counted`` of n-grams that are given by their letters."""

    def hashed(g: str) -> int:
        out = 0
        for x in _codes(np.array([ord(c) for c in g], np.uint32)).tolist():
            out = (out * FACTOR + x) % 2**64
        return out

    held = {g: v for g, v in counts.items() if sum(v)}
    keys = [np.array([hashed(f(g)) for g in held], np.uint64) for f in (lambda g: g, lambda g: g[:-1], lambda g: g[1:])]
    return [*keys, np.array([-len(g) if g[0] == START else len(g) for g in held], np.int64), *(np.array([v[c] for v in held.values()], np.int64) for c in (0, 1))]


class Model:
    """Differences of log-likelihoods, as a back-off table: seen n-grams, and contexts' weights for the others.

    ``counts`` has each n-gram's number in ordinary and in toxic documents, or is the
    columns of ``counted`` (taken out of the list); the n-grams inside of one are there
    too. The shared model is Kneser-Ney over both: discounted counts in a context,
    interpolated with how many letters the shorter n-grams were seen after. A class
    discounts its own counts in a context and shares what is left, with ``strength``
    more, as the shared model does there and as the class differs from it in the
    context one letter shorter. So each class has, for every n-gram, a ratio to the
    shared probability. The table is sorted hashes, with each one's logarithm and its
    weight as a context.
    """

    def __init__(self, counts: dict[str, tuple[int, int]] | list[np.ndarray], order: int = ORDER, shared: int = SHARED, discount: float = DISCOUNT, strength: float = STRENGTH):
        self.order, self.shared, self.evidence = order, shared, None
        columns = _listed(counts) if isinstance(counts, dict) else counts
        if len(columns[0]) > 1 and (columns[0][1:] <= columns[0][:-1]).any():
            by = np.argsort(columns[0])
            columns[:] = [c[by] for c in columns]
        self.gram = columns.pop(0)
        if len(self.gram) > 1 and (self.gram[1:] == self.gram[:-1]).any():
            raise ValueError("two n-grams have one hash")
        heads, context = np.unique(columns.pop(0), return_inverse=True)
        context = context.astype(np.int32)
        tail = np.searchsorted(self.gram, columns.pop(0)).astype(np.int32)  # means nothing for one letter
        letters = columns.pop(0)
        size, starts, rows = np.abs(letters).astype(np.int8), letters < 0, len(self.gram)
        own = [columns.pop(0), columns.pop(0)]
        raw = own[0] + own[1]
        lower = np.where(starts, raw, np.maximum(1, np.bincount(tail[size > 1], minlength=rows)[:rows])).astype(np.int32)
        row = lambda x, where=slice(None): np.bincount(context[where], x, len(heads))
        short = size < order
        sums = [(raw, row(raw), np.bincount(context, minlength=len(heads)).astype(np.int32)), (lower, row(lower[short], short), np.bincount(context[short], minlength=len(heads)).astype(np.int32))]
        spread = lambda k, at, up: (np.maximum(sums[k][0][at] - discount, 0) + discount * sums[k][2][context[at]] * up) / sums[k][1][context[at]]
        total = [strength + row(own[c]) for c in (0, 1)]
        left = [strength + discount * row(own[c] > 0) for c in (0, 1)]
        self.seen, self.weight = np.zeros(rows), np.zeros(rows)
        # A context of two letters and more is an n-gram itself.
        held = np.unique(context[size >= max(shared, 3)])
        self.weight[np.searchsorted(self.gram, heads[held])] = np.log(left[1][held] / total[1][held]) - np.log(left[0][held] / total[0][held])
        heads = held = None
        continued, ratios = np.zeros(rows), [np.ones(rows), np.ones(rows)]
        for n in range(1, order + 1):
            at = np.flatnonzero(size == n)
            up = continued[tail[at]] if n > 1 else 1 / (len(at) + 1)
            if n < order:
                continued[at] = spread(1, at, up)
            if n >= shared:
                p, h = spread(0, at, up), context[at]
                for c in (0, 1):
                    ratios[c][at] = (np.maximum(own[c][at] - discount, 0) / p + left[c][h] * ratios[c][tail[at]]) / total[c][h]
                self.seen[at] = np.log(ratios[1][at] / ratios[0][at])

    def words(self, words: list[str]) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each word."""
        spelt = Spelt(words)
        size, rows = len(spelt.code), len(self.gram)
        if not size or not rows:
            return np.zeros(len(words))
        out, last = np.zeros(size), np.zeros(size)
        before = np.full(size, -1)
        for n, own in spelt.hashes(self.order):
            if n < self.shared - 1:
                continue
            # All inside of a seen n-gram is seen, so one is looked for only where its shorter one was found.
            open_ = np.flatnonzero((spelt.upto >= n) & (spelt.upto > 1) & ((before >= 0) | (n <= self.shared)))
            at = np.minimum(np.searchsorted(self.gram, own[open_]), rows - 1)
            hit = self.gram[at] == own[open_]
            now = np.full(size, -1)
            now[open_[hit]] = at[hit]
            if n >= self.shared:
                ends = np.flatnonzero(spelt.upto >= n)
                seen = now[ends] >= 0
                last[ends[seen]] = self.seen[now[ends[seen]]]
                miss = ends[~seen]
                head = before[miss - 1]
                out[miss] += np.where(head >= 0, self.weight[head], 0.0)
            before = now
        return np.bincount(spelt.word, out + last, len(words))

    def word(self, word: str) -> float:
        return float(self.words([word])[0])


class Evidence(dict):
    """Words' evidence; what is kept is bounded by letters, so that no text fills a worker."""

    def __init__(self, model: Model, most: int = CACHE):
        self.model, self.most, self.letters = model, most, 0

    def of(self, texts: list[list[str]]) -> list[float]:
        """The length-normalised evidence of each list of words; unseen words of all are read together."""
        new = [w for w in set().union(*texts) if w not in self]
        told = np.maximum(self.model.words(new) - MARGIN, 0).tolist()
        passing = {w: x for w, x in zip(new, told, strict=True) if len(w) > LONG}
        self.update((w, x) for w, x in zip(new, told, strict=True) if len(w) <= LONG)
        self.letters += sum(map(len, new))
        get = (lambda w: passing[w] if len(w) > LONG else self[w]) if passing else self.__getitem__
        out = [sum(map(get, words)) / max(1, len(words)) ** POWER for words in texts]
        if self.letters > self.most:
            self.clear()
            self.letters = 0
        return out


def evidence(own: Evidence, texts: list[str | None]) -> np.ndarray:
    """A figure for each text; one without words has none."""
    out = []
    for i in range(0, len(texts), TEXTS):
        out += own.of([WORDS.findall((t or "").lower()) for t in texts[i : i + TEXTS]])
    return np.array(out, float)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 3e-4) -> np.ndarray:
    """Coefficients (the constant last) by Newton's method, on standardised features."""
    mean, scale = np.average(x, 0, weight), np.sqrt(np.average((x - np.average(x, 0, weight)) ** 2, 0, weight)) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    b, penalty = np.zeros(z.shape[1]), ridge * weight.sum() * np.r_[np.ones(x.shape[1]), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (weight * (y - p)) - penalty * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    slope = b[:-1] / scale
    return np.r_[slope, b[-1] - slope @ mean]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, list[int]] = {}

    def tables() -> Iterator[pa.RecordBatch]:
        names = list(found)
        for i in range(0, len(names), KINDS):
            columns = counted({w: found[w] for w in names[i : i + KINDS]}, ORDER)
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], COLUMNS)
        found.clear()

    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            for word in set(WORDS.findall((text or "").lower())):
                found.setdefault(word, [0, 0])[toxic] += 1
            if len(found) > 200_000:
                yield from tables()
    yield from tables()


def _evidence(shared) -> Evidence:
    """This worker's cache for a broadcast model; it goes when the worker drops the model."""
    model = shared.value
    if model.evidence is None:
        model.evidence = Evidence(model)
    return model.evidence


def _told(shared):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _evidence(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(evidence(own, b.column("text").to_pylist()))], ["toxic", "told"])

    return compute


def _scores(shared, slope: np.ndarray | None, share: float, names: list[str]):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _evidence(shared)
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                at = evidence(own, b.column("text").to_pylist())
                score = np.full(len(at), share) if slope is None else 1 / (1 + np.exp(-np.clip(at * slope[0] + slope[1], -500, 500)))
                yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(score)], [*names, "__score"])

    return compute


def _collected(table: DataFrame) -> list[np.ndarray]:
    """The columns of ``counted`` of a whole table by rising hash, fetched in slices of its first bits so that the driver never holds it twice."""
    slices = []
    for k in range(SLICES):
        part = table.where(F.shiftrightunsigned("gram", 64 - SLICES.bit_length() + 1) == k).toArrow()
        columns = [part.column(c).to_numpy() for c in COLUMNS]
        by = np.argsort(columns[0].view(np.uint64))
        slices.append([*(c.view(np.uint64)[by] for c in columns[:3]), columns[3][by].astype(np.int8), *(c[by].astype(np.int32) for c in columns[4:])])
        del part, columns
        pa.default_memory_pool().release_unused()
    out = []
    for _ in range(len(COLUMNS)):
        out.append(np.concatenate([x.pop(0) for x in slices]))
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The model, sent to the executors once, its coefficients and the share of toxic labels, from the labelled rows of docs.

    ``labels`` has doc_id and toxic; null ones are ignored, and a doc_id with any
    label 1 is toxic. Of documents of one doc_id the smallest text is learnt from.
    Without documents of both labels every score is the share of toxic labels.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = [known.where(F.col("toxic") == c).orderBy(*order).limit(sample) for c in (0, 1)]
    # At most 2 * sample rows, so they may go to every executor.
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    chosen = chosen.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3))).persist()
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    try:
        columns = [f"{c} long" for c in COLUMNS]
        every = chosen.where("part <> 0").select("text", "toxic").mapInArrow(_count_grams, ", ".join(columns)).groupBy(*COLUMNS[:4]).agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
        grams_of = staged(every, "grams")
        model = Model(_collected(grams_of))
        unstaged(grams_of)
        shared = docs.sparkSession.sparkContext.broadcast(model)
        # Rows: those of the sample, a few numbers each.
        held = chosen.where("part = 0").select("text", "toxic").mapInArrow(_told(shared), "toxic int, told double").toPandas().sort_values(["toxic", "told"])
    finally:
        chosen.unpersist()
    y = held.toxic.to_numpy(float)
    if len(set(y)) < 2:
        return shared, None, share
    weight = np.where(y == 1, totals[1] / y.sum(), totals[0] / (1 - y).sum())
    return shared, logistic(held[["told"]].to_numpy(), y, weight / weight.mean()), share


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learnt from; a null doc_id has none."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _with_scores(docs: DataFrame, labels: DataFrame, columns: list[str], sample: int) -> DataFrame:
    """The given columns of docs and __score, learnt from labels of rows that are not held out."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), sample)
    return docs.mapInArrow(_scores(*model, columns), docs.select(*columns).schema.add("__score", "double"))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs (doc_id, text).

    Other columns are ignored. A null or empty text has the evidence of no words.
    Repeated rows score alike.
    """
    score = F.col("__score")
    return _with_scores(docs.select("doc_id", "text"), labels, ["doc_id"], sample).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with their columns, that are not predicted toxic."""
    return _with_scores(docs, labels, docs.columns, sample).where(F.col("__score") < THRESHOLD).drop("__score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
