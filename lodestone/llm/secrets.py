"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

The patterns' findings are always reported. Every other run of 16 or more key
characters is a candidate; the network reads its characters and those around it and
decides. It is trained in numpy on labelled
findings that a seeded generator writes, its outputs are calibrated on findings set
aside, and its threshold is the highest that keeps the recall asked for there.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "network")
#: The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
#: A text without one of these has no assignment; checked in lower case.
WORDS = ("passw", "secret", "token", "api")
BEFORE, AFTER = 24, 8
#: Labelled findings that are generated, and the recall that the threshold keeps.
FINDINGS = 6000
RECALL = 0.97
SEED = 11
#: Names of hosts, and second-level names that are reserved for examples.
HOSTS = ("mail", "www", "server", "host", "smtp", "node", "db", "web", "files", "build")
RESERVED = ("example", "test", "invalid", "localhost")
#: Width of the convolution, filters, and positions read at once.
WIDTH, FILTERS, LETTER, ROLE, SEGMENT = 5, 24, 8, 4, 128
HALO = WIDTH // 2
IS_HEX = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' findings in code points, kinds by their number."""
    found = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"x" * 16 in text.encode().translate(IS_HEX):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of key characters that no base finding covers."""
    out = []
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))  # how far the findings up to each go
    for m in RUN.finditer(text):
        run = m[0].rstrip(".=-") if not m[0].endswith("=") else m[0].rstrip(".-")
        s, e = m.start(), m.start() + len(run)
        before = bisect_right(starts, s)
        if len(run) >= 16 and not (before and reach[before - 1] >= e):
            out.append((s, e))
    return out


def letters(text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the characters of a finding and around it, and their roles (1 before, 2 within, 3 after)."""
    a, b = max(0, start - BEFORE), min(len(text), end + AFTER)
    ids = np.frombuffer(text[a:b].encode("utf-32-le"), np.uint32)
    ids = np.where(ids < 128, ids + 1, 129).astype(np.int64)
    role = np.concatenate((np.full(start - a, 1), np.full(end - start, 2), np.full(b - end, 3)))
    return ids, role


class Network:
    """Embedding, one convolution, largest and mean activation, one output."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        deep = LETTER + ROLE
        self.p = {"e": rng.normal(0, 0.3, (130, LETTER)), "r": rng.normal(0, 0.3, (4, ROLE)), "w": rng.normal(0, (2 / (WIDTH * deep)) ** 0.5, (WIDTH * deep, FILTERS)), "b": np.zeros(FILTERS), "v": rng.normal(0, 0.1, 2 * FILTERS), "c": np.zeros(1)}
        self.p["e"][0] = self.p["r"][0] = 0

    def windows(self, ids: np.ndarray, role: np.ndarray) -> np.ndarray:
        x = np.concatenate((self.p["e"][ids], self.p["r"][role]), 2)
        x = np.pad(x, ((0, 0), (HALO, HALO), (0, 0)))
        return np.concatenate([x[:, k : k + ids.shape[1]] for k in range(WIDTH)], 2)

    def pooled(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Pooled activations of whole findings; long ones are read in segments that overlap by the convolution's reach."""
        cut = [(i, a) for i, (ids, _) in enumerate(texts) for a in range(0, len(ids), SEGMENT)]
        top, total = np.zeros((len(cut), FILTERS)), np.zeros((len(cut), FILTERS))
        for at in range(0, len(cut), 256):
            part = cut[at : at + 256]
            wide = max(min(len(texts[i][0]) - a, SEGMENT) for i, a in part) + 2 * HALO
            ids, role, core = np.zeros((len(part), wide), np.int64), np.zeros((len(part), wide), np.int64), np.zeros((len(part), wide), bool)
            for k, (i, a) in enumerate(part):
                lo, hi = max(0, a - HALO), min(len(texts[i][0]), a + SEGMENT + HALO)
                place = HALO - (a - lo)
                ids[k, place : place + hi - lo], role[k, place : place + hi - lo] = texts[i][0][lo:hi], texts[i][1][lo:hi]
                core[k, HALO : HALO + min(len(texts[i][0]) - a, SEGMENT)] = True
            h = np.maximum(self.windows(ids, role) @ self.p["w"] + self.p["b"], 0)
            top[at : at + 256] = (h * core[:, :, None]).max(1)
            total[at : at + 256] = (h * (core & (role == 2))[:, :, None]).sum(1)
        first = np.flatnonzero([a == 0 for _, a in cut])
        size = np.array([max(1, int((r == 2).sum())) for _, r in texts])
        return np.concatenate((np.maximum.reduceat(top, first), np.add.reduceat(total, first) / size[:, None]), 1)

    def logits(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return self.pooled(texts) @ self.p["v"] + self.p["c"] if texts else np.zeros(0)

    def gradients(self, ids: np.ndarray, role: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        x = self.windows(ids, role)
        h = np.maximum(x @ self.p["w"] + self.p["b"], 0)
        own, within = (role > 0)[:, :, None], (role == 2)[:, :, None]
        size = np.maximum(within.sum(1), 1)
        masked = h * own
        best = masked.argmax(1)
        pool = np.concatenate((masked.max(1), (h * within).sum(1) / size), 1)
        d = (1 / (1 + np.exp(-np.clip(pool @ self.p["v"] + self.p["c"], -30, 30))) - y) / len(y)
        back = d[:, None] * self.p["v"]
        dh = within * (back[:, FILTERS:] / size)[:, None, :]
        dh = np.broadcast_to(dh, h.shape).copy()
        rows, cols = np.arange(len(y))[:, None], np.arange(FILTERS)
        dh[rows, best, cols] += back[:, :FILTERS]
        dh *= (h > 0) & own
        dx = (dh @ self.p["w"].T).reshape(*ids.shape, WIDTH, -1)
        wide = np.zeros((len(y), ids.shape[1] + 2 * HALO, LETTER + ROLE))
        for k in range(WIDTH):
            wide[:, k : k + ids.shape[1]] += dx[:, :, k]
        wide = wide[:, HALO:-HALO]
        g = {"w": np.tensordot(x, dh, ((0, 1), (0, 1))), "b": dh.sum((0, 1)), "v": pool.T @ d, "c": d.sum(keepdims=True), "e": np.zeros_like(self.p["e"]), "r": np.zeros_like(self.p["r"])}
        np.add.at(g["e"], ids, wide[:, :, :LETTER])
        np.add.at(g["r"], role, wide[:, :, LETTER:])
        g["e"][0] = g["r"][0] = 0
        return g

    def train(self, ids: np.ndarray, role: np.ndarray, y: np.ndarray, seed: int, epochs: int = 6, batch: int = 64, rate: float = 4e-3) -> None:
        """Adam over seeded batches."""
        rng, t = np.random.default_rng(seed), 0
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(y)), -(-len(y) // batch)):
                t += 1
                for k, g in self.gradients(ids[at], role[at], y[at]).items():
                    m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)


def labelled(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """Findings (text, start, end, label) by a seeded generator, half of them secrets."""
    rng = np.random.default_rng(seed)
    pick = lambda seq, k: "".join(seq[i] for i in rng.integers(0, len(seq), k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve sch ein ung que ent ion ado ción keit lich ver ge be zu tz pf chen schaft heit berg gen".split()
    word = lambda a=1, b=4: pick(syllables, int(rng.integers(a, b)))
    num = lambda a, b: str(rng.integers(a, b))

    def secret() -> str:
        k = int(rng.integers(16, 72))
        return [
            lambda: pick("0123456789abcdef", int(rng.choice([16, 20, 32, 40, 64]))),
            lambda: pick(up + low + dig, k),
            lambda: pick(up + low + dig + "_-", k),
            lambda: base64.b64encode(rng.bytes(k)).decode(),
            lambda: pick(low, int(rng.integers(2, 5))) + rng.choice(["_", "-", "_live_", "-v1-"]) + pick(up + low + dig, k),
            lambda: pick(up, 4) + pick(up + dig, 16),
            lambda: ".".join(base64.urlsafe_b64encode(rng.bytes(j)).decode().rstrip("=") for j in (18, 40, 32)),
            lambda: pick(up + low, k),
            lambda: pick(low, k),
        ][rng.integers(0, 9)]()

    def ordinary() -> str:
        return [
            lambda: f"{word(2, 6)}.{word(2, 6)}.com/{word()}/{num(10, 99999)}",
            lambda: f"{word(1, 4)}-{word(1, 4)}-{word(1, 4)}-{num(1, 3000)}",
            lambda: f"20{num(10, 30)}-{num(10, 13)}-{num(10, 29)}T{num(10, 24)}-{num(10, 60)}-{num(10, 60)}Z",
            lambda: f"{word(1, 3)}_{word(1, 3)}_{word(1, 4)}_{num(10, 999)}",
            lambda: f"{word(1, 3)}.{num(10, 99)}/{word(1, 3)}.{num(10, 99)}.{word(1, 3)}",
            lambda: word(2, 4) + word(2, 4).capitalize() + word(2, 5).capitalize() + num(10, 99),
            lambda: f"{word(1, 3)}/{word(1, 3)}/{word(2, 4)}.v{num(1, 20)}.{num(1, 99)}.txt",
            lambda: f"{word(2, 5)}{num(10, 99)}={num(1, 99)}.{num(0, 99)}/{word(2, 4)}",
            lambda: f"{num(10**7, 10**9)}-{num(10**6, 10**8)}{rng.choice(['a', 'kB', 'x', 'EUR'])}",
            lambda: word(4, 9) + num(10, 2030),
            lambda: rng.choice(["a", "x1", "0f", "=-", "ab12"]) * int(rng.integers(9, 20)) + "10",
            lambda: word(6, 12),
            lambda: word(2, 4) + "".join(word(2, 4).capitalize() for _ in range(3)),
            lambda: rng.choice(["-", "_", "/", "."]).join(word(1, 5) for _ in range(int(rng.integers(3, 8)))),
            lambda: word(6, 12).upper(),
            lambda: word(5, 8).capitalize(),
            lambda: f"{word(1, 3)}{num(0, 30)}.{word(2, 5)}.{rng.choice(['com', 'org', 'net', 'de'])}",
            lambda: rng.choice(list("_=/+a")) * int(rng.integers(16, 60)),
            lambda: f"{rng.choice(HOSTS)}{num(0, 40)}.{rng.choice(RESERVED)}.{rng.choice(['com', 'org', 'net'])}",
            lambda: num(10**8, 10**9) + num(10**8, 10**9) + num(10, 9999),
        ][rng.integers(0, 20)]()

    out = []
    while len(out) < n:
        label = len(out) % 2
        text = secret() if label else ordinary()
        if len(text) < 16:
            continue
        lead = [lambda: "", lambda: " ".join(word() for _ in range(5)) + " ", lambda: f"{word()}: ", lambda: f'{word()} = "', lambda: f"{word()}.\n", lambda: f"({word()} "][rng.integers(0, 6)]()
        if label and rng.random() < 0.4:
            lead = str(rng.choice(["key=", "Bearer ", "auth: ", "credential = ", 'pwd="', "private key ", "access ", "signature="]))
        out.append((lead + text + str(rng.choice(["", " ", '"', ".\n", " and"])) + word(), len(lead), len(lead) + len(text), label))
    return out


@lru_cache(maxsize=4)
def trained(findings: int = FINDINGS, recall: float = RECALL, seed: int = SEED) -> tuple[Network, float, float, float]:
    """The network, its calibration (slope, constant) and the threshold on calibrated outputs."""
    data = labelled(findings, seed)
    coded = [letters(t, s, e) for t, s, e, _ in data]
    y = np.array([x[3] for x in data], float)
    aside = np.arange(len(y)) % 10 >= 8
    wide = max(len(i) for i, _ in coded)
    ids, role = (np.stack([np.pad(c[k], (0, wide - len(c[k]))) for c in coded]) for k in (0, 1))
    net = Network(seed)
    net.train(ids[~aside], role[~aside], y[~aside], seed)
    z = net.logits([c for c, a in zip(coded, aside, strict=True) if a])
    slope, const = calibrated(z, y[aside])
    p = 1 / (1 + np.exp(-(slope * z + const)))
    return net, slope, const, float(np.quantile(p[y[aside] == 1], 1 - recall, method="lower"))


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A logistic curve from outputs to probabilities."""
    b = np.array([1.0, 0.0])
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x = np.c_[z, np.ones(len(z))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (goal - p) - 1e-6 * b)
        b += np.clip(step, -2, 2)
    return float(b[0]), float(b[1])


def all_spans(texts: list[str], model: tuple[Network, float, float, float]) -> list[list[tuple[int, int, int, float]]]:
    """(start, kind, end, probability) of all findings of each text; the network's have the last kind.

    The network reads the patterns' findings too: they stay whatever it says.
    """
    net, slope, const, least = model
    open_ = []
    for i, t in enumerate(texts):
        base = base_spans(t)
        open_ += [(i, *x) for x in base] + [(i, s, 3, e) for s, e in candidates(t, base)]
    z = net.logits([letters(texts[i], s, e) for i, s, _, e in open_])
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    for (i, s, k, e), p in zip(open_, 1 / (1 + np.exp(-np.clip(slope * z + const, -500, 500))), strict=True):
        if k < 3 or p >= least:
            out[i].append((s, k, e, float(p)))
    return [sorted(x) for x in out]


def written(spans: list[tuple[int, int, int, float]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def _short(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that a worker holds few texts at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _scanned(model):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _short(batches):
            found = all_spans([t or "" for t in b.column("text").to_pylist()], model)
            base = [[x for x in f if x[1] < 3] for f in found]
            counts = [pa.array([sum(x[1] == k for x in f) for f in base], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array([hashlib.sha256(written(f).encode()).hexdigest() for f in base], pa.string()), pa.array(list(map(written, found)), pa.string()), pa.array([[round(x[3], 4) for x in f] for f in found], pa.list_(pa.float64()))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores"])

    return scan


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and scores (the network's, span by span) of each row of docs (doc_id, text).

    Other columns are ignored. A null text is empty and has no findings; repeated
    rows each get a row.
    """
    return docs.select("doc_id", "text").mapInArrow(_scanned(trained()), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, scores array<double>")


def redacted(text: str, spans: list[tuple[int, int, int, float]], mark: str = "[SECRET]") -> str:
    """The text with each stretch of findings replaced by a mark."""
    out, at = [], 0
    for s, _, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with its columns, secrets in text replaced; n_chars, if there, follows."""
    model = trained()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _short(batches):
            texts = b.column("text").to_pylist()
            found = all_spans([t or "" for t in texts], model)
            new = pa.array([t and redacted(t, f) for t, f in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == "text" else b.column(c) for c in b.schema.names], b.schema.names)

    out = docs.mapInArrow(clean, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
