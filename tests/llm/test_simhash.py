import random

import numpy as np
import xxhash

from lodestone.llm import simhash


def brute(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    return out


def groups(fps, ids, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def near(rng, base, bits):
    for b in rng.sample(range(64), bits):
        base ^= 1 << b
    return base


def test_sliced_forest_connects_what_brute_force_connects():
    rng = random.Random(3)
    for radius in (0, 1, 3, 4, 6):
        fps, keys = [], []
        for k, size in enumerate((1, 2, 70, 200, 3)):
            seeds = [rng.getrandbits(64) for _ in range(4)]
            fps += [near(rng, rng.choice(seeds), rng.randint(0, 7)) for _ in range(size)]
            keys += [k] * size
        got = simhash.sliced_forest(np.array(keys), np.array(fps, np.uint64), radius, slab=100).tolist()
        far = [f | k << 64 | (2 ** (20 * k) - 1) << 80 for f, k in zip(fps, keys)]
        assert got == groups(far, range(len(far)), radius)


def test_links_and_components_with_tiles(spark):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({near(rng, rng.choice(seeds), rng.randint(0, 5)) for _ in range(400)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for tile in (16384, 8):
        roots = {r.u: r.v for r in simhash.components(simhash.links(df, tile_rows=tile)).collect()}
        want = groups(fps, range(len(fps)), 4)
        got = [roots.get(x, x) for x in signed]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_documents_with_odd_rows(spark):
    long = "Lorem ipsum dolor sit amet " * 4000
    rows = [(1, "a b c d e f g"), (2, "A b  c d\ne f g"), (3, None), (4, ""), (5, " \t"), (6, "é ü"), (None, "a b c d e f g"), (7, long), (1, "a b c d e f g"), (9, "one two"), (None, "alone here it is")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, fp int, digest string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp % 2**64, r.component_id) for r in simhash.simhash_groups(df).collect())
    fps = brute([t for _, t in rows])
    comp = groups(fps, [d for d, _ in rows], 4)
    assert got == sorted((d if d is not None else -1, f, c) for (d, _), f, c in zip(rows, fps, comp))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(d or -1 for d in {1, 3, 6, 7, 9, None})
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_components_without_ids_stay_apart(spark):
    rows = [(None, "alone here it is"), (None, "something else stands over there"), (None, "something else stands over there"), (3, "one two")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in kept) == ["alone here it is", "one two", "something else stands over there"]


def test_hot_middles_are_broadcast(spark, monkeypatch):
    rng = random.Random(11)
    edges = [(1, k) for k in range(2, 400)] + [(400 + i, 401 + i) for i in range(60)] + [(399, 400), (1000, 1001), (-5, 1001)] + [(rng.randint(1000, 1060), rng.randint(1000, 1060)) for _ in range(80)]
    df = spark.createDataFrame(edges, "u long, v long")
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    for most in (20, 10**6):
        monkeypatch.setattr(simhash, "STAR_ROWS", most)
        assert {r.u: r.v for r in simhash.components(df).collect()} == {k: v for k, v in label.items() if k != v}


def test_rounds_have_small_plans(spark, monkeypatch):
    read, kept = [], simhash.staged

    def staged(df, name):
        read.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return kept(df, name)

    monkeypatch.setattr(simhash, "staged", staged)
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "u long, v long")
    assert {r.u: r.v for r in simhash.components(chain).collect()} == {i: 0 for i in range(1, 21)} | {51: 50}
    # A half of a round reads its edges for their least neighbours, the hot ones and the others: the driver plans and keeps as much as this.
    assert len(read) > 3 and max(read) <= 12


def test_no_round_is_made_to_see_that_none_is_needed(spark, monkeypatch):
    made, kept = [], simhash.staged

    def staged(df, name):
        made.append((name, df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")))
        return kept(df, name)

    monkeypatch.setattr(simhash, "staged", staged)
    done = spark.createDataFrame([(k, k % 5) for k in range(5, 60)], "u long, v long")
    assert {r.u: r.v for r in simhash.components(done).collect()} == {k: k % 5 for k in range(5, 60)}
    assert [name for name, _ in made] == ["stars", "least"]
    made.clear()
    chain = spark.createDataFrame([(k, k + 1) for k in range(3)], "u long, v long")
    assert {r.u: r.v for r in simhash.components(chain).collect()} == {k: 0 for k in range(1, 4)}
    # What is dealt out by a key: a join's two sides and what is told apart, each once.
    assert len(made) > 2 and max(n for _, n in made) <= 3


def test_few_large_buckets_do_not_deal_all_rows_twice(spark):
    plan = simhash.links(spark.range(50).selectExpr("id fp"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan


def test_few_edges_are_finished_by_the_driver(spark, monkeypatch):
    made, kept = [], simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, name: made.append(name) or kept(df, name))
    rng = random.Random(12)
    edges = [(rng.randint(-40, 40) << 40, rng.randint(-40, 40) << 40) for _ in range(280)]
    df = spark.createDataFrame(edges, "u long, v long")
    want = {r.u: r.v for r in simhash.components(df).collect()}
    for gathered, rounds in ((300, 0), (100, 1)):
        made.clear()
        found = simhash.components(df, gathered)
        assert {r.u: r.v for r in found.collect()} == want and found.columns == ["u", "v"]
        assert made[-1] == "roots" and (made.count("large") > 0) == (rounds > 0)
    assert simhash.components(df.limit(0), 300).count() == 0
