"""Best-fit packing of tokenised documents, planned over a histogram of lengths.

The driver plans with counts of piece lengths (never more of them than a sequence
has tokens), placing whole groups of equal pieces into whole groups of equally full
sequences, best fit, longest first. A row of the plan says that pieces of one length
with ranks from ``rank`` on lie at one offset of consecutive sequences. Documents
then take their slots by their rank within their length.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.plans.staging import staged

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE = 2048
#: Pieces for which there is a part in which the ranks of a length are counted, so that a hot length is shared by as many tasks as it needs.
PART_ROWS = 20_000
LEAST_PARTS = 8
#: Rows that a worker reads at once.
ROWS = 512


def byte_ranks(model: Tokenizer) -> dict[bytes, int] | None:
    """The ids of a byte-level BPE by their bytes, where the order of merges is that of ids; else None."""
    spec = json.loads(model.to_str())["model"]
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that are written as themselves
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocab = {t: i for t, i in spec.get("vocab", {}).items() if all(c in letters for c in t)} if spec["type"] == "BPE" else {}
    merges = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in spec.get("merges", [])]
    if len(merges) + 256 != len(vocab) or None in merges or merges != sorted(merges) or min(merges, default=0) < 256:
        return None
    return {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in model.get_added_tokens_decoder()}


class Encoder:
    """The library's byte-level BPE ids of whole texts, as little-endian 32-bit bytes.

    A lighter library with the same pattern and merges encodes whole texts and keeps
    nothing. Texts that hold an added token's string go to the tokenizers library, and
    so do all if the order of merges is not that of ids. ``cache`` is taken from older
    callers and not used.
    """

    #: The byte-level pre-tokenizer's pattern.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    #: Runs of white space that are longer than the lighter library's pattern is given where it runs out of stack.
    RUNS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")

    def __init__(self, path: str, cache: int = 0):
        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.ranks = byte_ranks(self.model)
        self.quick = self.merges(self.PATTERN) if self.ranks else None
        self.uncut = None

    def merges(self, pattern: str) -> tiktoken.Encoding:
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.asarray(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def around_runs(self, text: str) -> bytes:
        """The ids of a text in which each long run of white space is a cut but for its last character, which the next cut may begin with."""
        self.uncut = self.uncut or self.merges("(?s).+")
        out, at = [], 0
        for run in self.RUNS.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += [_ids(self.quick, text[at : run.start()]), _ids(self.uncut, text[run.start() : end])]
            at = end
        return b"".join([*out, _ids(self.quick, text[at:])])

    def __call__(self, text: str) -> bytes:
        if not self.quick or any(a in text for a in self.added):
            return self.whole(text)
        for encode in (lambda x: _ids(self.quick, x), self.around_runs):
            try:
                return encode(text)
            except ValueError:  # the pattern's stack is too small for a run of white space
                pass
        return self.whole(text)


def _ids(library: tiktoken.Encoding, text: str) -> bytes:
    return library.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


_encoder: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    if path not in _encoder:
        _encoder[path] = Encoder(path)
    return _encoder[path]


def pieces(ids: bytes, sequence: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece of a document's ids; a remainder comes first."""
    n = len(ids) // 4
    head = n if n <= sequence else n % sequence or sequence
    bounds = [0, *range(head, n + 1, sequence)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(bounds, bounds[1:], strict=False)]


def _cut(path: str, sequence: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_for(path)
        for whole, k in ((x, k) for x in batches for k in range(0, x.num_rows, ROWS)):
            b, at, rows = whole.slice(k, ROWS), [], []
            for i, text in enumerate(b.column("text")):
                found = pieces(encode(text.as_py() or "") + bytes(4), sequence)
                at += [i] * len(found)
                rows += [(n, *x) for n, x in enumerate(found)]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> np.ndarray:
    """Best-fit-decreasing over counts: rows (length, rank, n, sequence_id, offset).

    Sequences with equally much room are alike, and what is in them ends where their
    room begins, so a group of them is a range of ids.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges (first id, ids)
    next_id = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            fits = min((r for r in room if r >= length), default=sequence)
            if fits in room:
                first, ids = room[fits].pop()
                if not room[fits]:
                    del room[fits]
            else:
                first, ids = next_id, -(-left // (sequence // length))
                next_id += ids
            each = fits // length  # what best fit puts into one of them before it turns to the next
            full = min(ids, left // each)
            some = left % each if full < ids else 0
            for k in range(each):
                if full:
                    rows.append((length, rank, full, first, sequence - fits + k * length))
                    rank += full
            if full:
                room.setdefault(fits - each * length, []).append((first, full))
            for k in range(some):
                rows.append((length, rank, 1, first + full, sequence - fits + k * length))
                rank += 1
            if some:
                room.setdefault(fits - some * length, []).append((first + full, 1))
            rest = ids - full - (some > 0)
            if rest:
                room.setdefault(fits, []).append((first + ids - rest, rest))
            left = histogram[length] - rank
        room.pop(0, None)
    return np.array(rows, np.int64).reshape(-1, 5)


def _placed(slots: np.ndarray):
    # Rows of one length are together and their ranks rise.
    order = np.lexsort((slots[:, 1], slots[:, 0]))
    length, rank, _, first, offset = slots[order].T

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = {int(v): i for i, v in reversed(list(enumerate(length)))}
        scale = int(rank.max(initial=0)) + 1
        keys = [int(a) * scale + int(b) for a, b in zip(length, rank, strict=True)]
        wide = keys and keys[-1] > sys.maxsize
        known = None if wide else np.array(keys, np.int64)
        for b in batches:
            of, at = b.column("length").to_numpy(), b.column("rank").to_numpy()
            if wide:
                own = np.fromiter((begin[n] + np.searchsorted(rank[length == n], r, "right") - 1 for n, r in zip(of.tolist(), at.tolist(), strict=True)), np.int64, len(of))
            else:
                own = np.searchsorted(known, of * scale + at, "right") - 1
            columns = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first[own] + at - rank[own]), pa.array(offset[own])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, sequence: int = SEQUENCE, tokenizer: str | None = None, part_rows: int = PART_ROWS, least_parts: int = LEAST_PARTS) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text), with its place.

    Other columns are ignored. A null text is empty and has the closing id 0 alone;
    repeated rows are packed as often as they occur, and equal pieces are
    interchangeable. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    cut = staged(docs.select("doc_id", "text").mapInArrow(_cut(tokenizer or public_tokenizers.path(TOKENIZER), sequence), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    parted = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(least_parts, -(-cut.count() // part_rows)))))
    counts = staged(parted.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    slots = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, sequence)
    # Ranks: those of the parts before, and the place within the part.
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = parted.withColumn("own", own).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked.select(*columns).mapInArrow(_placed(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, packed."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
