import math
import random
import zlib
from collections import defaultdict

import pytest

from lodestone.llm import toxicity


def naive(counts, g, c, order=6, d=0.9, strength=200.0):
    """A class's ratio to the shared probability of the last letter of g after the others, and that probability, by their definitions."""
    raw = {k: sum(v) for k, v in counts.items()}
    lower = {k: n if k[0] == "\x02" else max(1, sum(1 for x in counts if x[1:] == k)) for k, n in raw.items() if len(k) < order}
    least = 1 / (sum(1 for k in lower if len(k) == 1) + 1)

    def prob(g, seen=lower):
        if not g:
            return least
        row = {k: n for k, n in seen.items() if k[:-1] == g[:-1]}
        up, n = prob(g[1:]), sum(row.values())
        return (max(row.get(g, 0) - d, 0) + d * len(row) * up) / n if n else up

    if len(g) < 3:
        return 1.0
    row = {k: v[c] for k, v in counts.items() if k[:-1] == g[:-1] and v[c]}
    return (max(row.get(g, 0) - d, 0) / prob(g, raw) + (strength + d * len(row)) * naive(counts, g[1:], c)) / (strength + sum(row.values()))


def test_word_is_the_models_definition():
    rng = random.Random(1)
    counts = defaultdict(lambda: [0, 0])
    for c in (0, 1):
        for _ in range(40):
            w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
            for g in toxicity.grams(w):
                counts[g][c] += 1
    counts = {g: tuple(v) for g, v in counts.items()}
    model = toxicity.Model(counts)
    for w in ("abc", "a", "cabba", "zzzz", "abcabcabab", "bzcaab"):
        text = f"\x02{w}\x03"
        want = sum(math.log(naive(counts, g, 1) / naive(counts, g, 0)) for g in (text[max(0, i - 6) : i] for i in range(2, len(text) + 1)))
        assert model.word(w) == pytest.approx(want, abs=1e-9)


def test_held_out_documents_and_odd_rows(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abdefghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    rows, labels = [], []
    for i in range(900):
        t = rng.choices(words, k=rng.randint(5, 120))
        bad = i % 6 == 0
        for _ in range(rng.randint(1, 3) * bad):
            t.insert(rng.randrange(len(t)), rng.choice(["grublik", "snarfen", "snarfel", "snarfish"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    odd = [(None, None), (5000, ""), (5001, None), (0, rows[0][1]), (5002, "x" * 100_000), (5003, "grublik " * 3)]
    docs = spark.createDataFrame([(*r, "k") for r in rows + odd], "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (None, 1), (7, None), (5001, 0)], "doc_id long, toxic int")
    got = toxicity.scored(docs, known).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = dict(labels)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    away = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in away) / len(away) > 0.95
    assert next(r for r in got if r.doc_id == 5003).predicted == 1
    again = toxicity.scored(docs.repartition(3), known).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert toxicity.scored(docs.limit(0), known).count() == 0
    assert {r.score for r in toxicity.scored(docs, known.limit(0)).collect()} == {0.0}
    kept = toxicity.keep_ordinary(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_every_ngram_of_the_sample_is_counted(spark):
    rng = random.Random(5)
    draw = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
    rows = [(i, " ".join([*(draw() for _ in range(60)), *(["common"] if i % 3 else ["grublik"] * (i % 2))])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic")
    counts = defaultdict(lambda: [0, 0])
    for r in docs.where("pmod(xxhash64(doc_id, 7), 3) <> 0").collect():
        for w in set(r.text.split()):
            for g in toxicity.grams(w):
                counts[g][r.doc_id % 2] += 1
    assert len(counts) > 260_000
    want, got = toxicity.Model(dict(counts)), toxicity.fit(docs, labels)[0].value
    for w in ("grublik", "grublikanism", "common", "zz", *rows[0][1].split()[:5], *rows[1][1].split()[:5]):
        assert got.word(w) == pytest.approx(want.word(w), abs=1e-9)


def test_a_texts_figure_by_its_definition():
    counts = defaultdict(lambda: [0, 0])
    for c, words in ((1, ["grublik", "grubish", "snarf"]), (0, ["common", "usual", "grass", "plain"])):
        for w in words * 30:
            for g in toxicity.grams(w):
                counts[g][c] += 1
    model = toxicity.Model({g: tuple(v) for g, v in counts.items()}, strength=5.0)
    texts = ["grublik", "common grublik snarf usual", "", "--", None, "Grubish " * 3 + "plain " * 40, "q" * 5000 + " snarf", "common"]
    plain = []
    for t in texts:
        words = toxicity.WORDS.findall((t or "").lower())
        plain.append(sum(max(model.word(w) - toxicity.MARGIN, 0) for w in words) / max(1, len(words)) ** toxicity.POWER)
    assert plain[0] > 0 and plain[7] == 0
    for most in (10**6, 3):
        own = toxicity.Evidence(model, most)
        assert toxicity.evidence(own, texts * 40).tolist() == pytest.approx(plain * 40) and own.letters <= most
