import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import product

from pyspark.sql import functions as F

from lodestone.llm import mixing


def test_targets_reshare_what_is_above():
    got = mixing.targets([100, 1, 50, 0], [5, 2, 1, 5])
    assert got[1] == 3 and got[3] == 0 and sum(got) == 151
    assert got[0] == Fraction((151 - 3) * 5, 6)
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]


def cost(words, sent, repeats):
    return sum(sum(k * max(0, min(w, f - k * w)) for k in range(repeats)) for w, f in zip(words, sent))


def test_route_is_a_cheapest_largest_flow():
    rng = random.Random(8)
    for _ in range(60):
        patterns = [(rng.randint(0, 3), m) for m in rng.sample([(0,), (1,), (0, 1), (0, 1, 2), (2,), (1, 2)], 3)]
        quotas = [rng.randint(0, 6) for _ in range(3)]
        flow = mixing.route(patterns, quotas, 3)
        sent = [sum(f.values()) for f in flow]
        assert all(s <= 3 * w for s, (w, _) in zip(sent, patterns))
        assert all(sum(f.get(s, 0) for f in flow) <= quotas[s] for s in range(3))
        best = (0, 0)
        for total in product(*(range(3 * w + 1) for w, _ in patterns)):
            if all(sum(t for t, (_, m) in zip(total, patterns) if set(m) <= {i for i in range(3) if mask >> i & 1}) <= sum(quotas[i] for i in range(3) if mask >> i & 1) for mask in range(8)):
                best = max(best, (sum(total), -cost([w for w, _ in patterns], total, 3)))
        assert (sum(sent), -cost([w for w, _ in patterns], sent, 3)) == best


ROWS = [(i, "w " * (i % 9 + 1), "abcde"[i % 5] if i % 3 else "a") for i in range(200)] + [(900, None, "a"), (901, "x y", None), (902, "", None), (None, "n u l l", "b"), (3, "w w", "zz"), (3, "w w", "zz"), (910, "long " * 30000, "c")]


def test_mix_by_brute_force(spark):
    df = spark.createDataFrame([(*r, 5) for r in ROWS], "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    size = Counter()
    for _, t, s in ROWS:
        size[s] += len(re.findall(mixing.WORD, t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    assert sorted(r.size for r in got) == sorted(len((t or "").split()) for _, t, _ in ROWS)
    of = defaultdict(int)
    by = {(d, t): s for d, t, s in ROWS}
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    for r in got:
        of[(r.source_size, r.target)] += r.taken
    want = Counter()
    for s in names:
        want[(size[s], float(goal[s]))] += float(goal[s])
    assert of.keys() == want.keys() and all(abs(of[k] - want[k]) <= 3 for k in want) and by
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(df.limit(0)).count() == 0
    full = mixing.mixed_documents(df)
    assert full.columns == df.columns
    assert full.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r.taken for r in got)
    assert Counter(r.doc_id for r in full.collect())[910] >= 1


def test_goals_of_many_sources_by_the_definition(spark):
    rng = random.Random(4)
    size = {f"s{i:05d}": rng.choice([0, 1, 2, 5, 40, 3000]) for i in range(3000)} | {None: 7, "a\uffff": 3, "a\U00010000": 3}
    df = spark.createDataFrame([([s], n) for s, n in size.items()], "__pattern array<string>, words long")
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(names, mixing.targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    got = {r[0]: r for r in mixing.source_goals(df).collect()}
    assert got.keys() == want.keys()
    assert all(got[s]["__target"] == float(want[s]) and abs(got[s]["__goal"] - want[s]) <= 0.5 and got[s]["__source_size"] == size[s] for s in want)


def test_more_sources_than_any_bound_and_clashing_names(spark):
    rows = [(i, "a b c", f"src{i % 700}", 1, 2, 3) for i in range(2100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, passes int, target int, cut int")
    got = mixing.mix(df).collect()
    assert len(got) == 2100 and abs(sum(r.taken for r in got) - 6300) <= 350 and all(r.taken <= 9 for r in got)
    full = mixing.mixed_documents(df)
    assert full.columns == df.columns
    assert full.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r.taken for r in got)


def test_overlapping_sources(spark):
    df = spark.createDataFrame([(i, "a b c d", ["x", "y"] if i % 2 else ["x"]) for i in range(40)] + [(99, "q", [])], "doc_id long, text string, sources array<string>")
    got = mixing.mix(df, F.col("sources"), weights=(1, 1)).collect()
    assert sum(r.taken for r in got if r.doc_id == 99) == 0
    assert all(r.taken <= 12 for r in got)
