import math
import random

import numpy as np
import pytest

from lodestone.llm import ann, exact_topk, grid


def rows():
    rng = random.Random(12)
    out = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(260)]
    out += [(300 + i, out[7][1]) for i in range(60)]  # ties
    out += [(400, None), (420, [0.0] * 8), (None, out[3][1]), (440, [1.0, None] + [0.0] * 6), (460, [float("nan")] + [1.0] * 7), (480, [float("inf")] + [1.0] * 7), (500, [1.0, 2.0]), (520, [2.0, 1.0]), (540, []), (20, out[20][1]), (20, out[21][1]), (31, out[5][1])]
    return [(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x]) for i, x in out]


def brute(data, every, k, zero, score):
    rows = [(i, x) for i, x in data if i is not None and x is not None and None not in x and all(map(math.isfinite, x)) and (zero or any(x))]
    out = []
    for at, (q, x) in enumerate(rows):
        if q % every == 0:
            found = [(score(x, y), c) for other, (c, y) in enumerate(rows) if other != at and len(x) == len(y)]
            out += [(q, r, c, s) for r, (s, c) in enumerate(sorted(found, key=lambda p: (-p[0], p[1]))[:k], 1)]
    return sorted(out)


def inner(a, b):
    s = 0.0
    for x, y in zip(a, b):
        s += x * y
    return s


def whole(a, b):
    return sum(math.floor(1024 * x) * math.floor(1024 * y) for x, y in zip(a, b))


def test_neighbours_and_top_scores_by_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(i, x, 1) for i, x in data], "vec_id long, embedding array<float>, score int")
    assert sorted(map(tuple, ann.neighbours(df).collect())) == brute(data, 20, 20, False, inner)
    assert sorted(map(tuple, exact_topk.top_scores(df).collect())) == brute(data, 100, 10, True, whole)
    assert ann.neighbours(df.limit(0)).count() == exact_topk.top_scores(df.limit(0)).count() == 0


def test_repeated_ids_and_rows_are_rows_of_their_own(spark):
    data = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [0.5, 1.0]), (0, [1.0, 0.0]), (0, [5.0, 5.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for query, every, k, zero, score in ((ann.neighbours, 20, 20, False, inner), (exact_topk.top_scores, 100, 10, True, whole)):
        assert sorted(map(tuple, query(df).collect())) == brute(data, every, k, zero, score)


@pytest.mark.parametrize("module", [ann, exact_topk])
def test_many_tiles_and_a_hot_id(spark, module):
    rng = np.random.default_rng(8)
    data = [(int(i), rng.normal(size=4).round(2).tolist()) for i in [*range(700), *[300] * 350]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    score, every, k = (inner, 20, 20) if module is ann else (whole, 100, 10)
    got = grid.nearest(df, every, k, module.tile_best, zero=True, exact=module is exact_topk, tile_rows=60)
    assert sorted(map(tuple, got.collect())) == brute(data, every, k, True, score)


@pytest.mark.parametrize("dim", [3, 1500])
def test_tiles_by_brute_force(dim):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, dim)).astype(np.float32).astype(np.float64)
    x[100:160] = x[3]
    ids = np.sort(rng.integers(0, 800, 900))
    exact = x[:12] @ x.T
    for module in (ann, exact_topk):
        q, c, s = module.tile_best(x[:12], [None] * 12, x, ids, 20)
        scores = exact if module is ann else np.floor(1024 * x[:12]) @ np.floor(1024 * x).T
        for i in range(12):
            want = np.lexsort((ids, -np.round(scores[i], 9)))[:20]
            assert c[q == i].tolist() == ids[want].tolist() and np.allclose(s[q == i], scores[i][want])


def test_repeated_ids_do_not_change_what_survives(monkeypatch):
    rng = np.random.default_rng(6)
    x, read = rng.normal(size=(4000, 32)), []
    plain = ann.inner
    monkeypatch.setattr(ann, "inner", lambda a, b: read.append(len(a)) or plain(a, b))
    counts = []
    for ids in (np.arange(4000), np.repeat(np.arange(2000), 2)):
        ann.tile_best(x[:100], [None] * 100, x, ids, 20)
        counts.append(sum(read))
        read.clear()
    assert counts[0] == counts[1] < 400_000 / 8


def test_blocks_are_left_out_below_the_kth_score():
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(20, 8)) * 9
    x = np.floor(1024 * (np.repeat(centre, 256, axis=0) + rng.normal(size=(5120, 8))))
    blocks = exact_topk.Blocks(x, np.arange(5120))
    alone, told = (blocks.best(x[700], least, 10) for least in (None, None))
    told = blocks.best(x[700], int(alone[1][-1]), 10)
    want = np.lexsort((np.arange(5120), -(x @ x[700])))[:10]
    assert alone[0].tolist() == told[0].tolist() == want.tolist()
    assert told[2] <= alone[2] < 20 < len(blocks.starts)


def test_large_components_stay_exact():
    x = np.array([[3e37, 1.0], [-3e37, 2.0], [2e18, 5.0], [1.0, 1.0], [1e308, -1e308]])
    q, c, s = exact_topk.tile_best(x[3:4], [None], x, np.arange(5), 4)
    assert c.tolist() == [0, 2, 3, 4] and s.tolist()[0] == 2**63 - 1 and s.tolist()[3] == 0
    x = np.array([[1e200, 1e200], [1e200, -1e200], [1e200, 0.0], [1.0, 2.0], [3.0, 1.0]])
    q, c, s = ann.tile_best(x, [None] * 5, x, np.arange(5), 5)
    assert c[q == 0].tolist() == [0, 2, 4, 3, 1] and s[q == 0].tolist() == [math.inf, math.inf, 4e200, 3e200, 0.0]
    assert c[q == 4].tolist() == [0, 2, 1, 4, 3] and s[q == 4].tolist() == [4e200, 3e200, 2e200, 10.0, 5.0]
