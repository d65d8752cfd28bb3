"""Hard negatives against brute force over whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"


def by_force(rows: list[tuple], step: int, positives: int = 5, negatives: int = 3, scale: int = 256) -> list[tuple]:
    whole: dict[int, tuple] = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(np.float32(x)) for x in v):
            continue
        own = (label, len(v), [max(-(2**61), min(2**61, math.floor(float(np.float32(x)) * scale))) for x in v])
        if i not in whole or own < whole[i]:
            whole[i] = own
    out = []
    for a, (label, d, q) in whole.items():
        if a % step:
            continue
        score = {i: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(q, v, strict=True)))) for i, (_, n, v) in whole.items() if n == d and i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if whole[i][0] == label][:positives]:
            hard = [i for i in order if whole[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:negatives]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, step, **settings) -> list[tuple]:
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in N.mine(df, F.col("vec_id") % step == 0, **settings).collect())


def table(n: int, seed: int, spread: float = 1.0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(n):
        v = (centres[i % 6] + spread * rng.normal(size=8)).astype("f4")
        rows.append((i, [float(x) for x in v], int(i % 4), 1, "s"))
    return rows


def edges(rows: list[tuple]) -> list[tuple]:
    more = [(9000, None, 1), (9001, [], 1), (9002, [1.0, None] * 4, 1), (9003, [float("nan")] * 8, 1), (9004, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (9005, [1.0] * 8, None), (9010, [1.0, 2.0], 1), (9020, [1.0, 2.5], 1), (9030, [1.0, 1.5], 2), (9040, [0.0] * 8, 1), (9050, [0.0] * 8, 2)]
    more += [(9100 + i, rows[0][1], 0) for i in range(40)] + [(9200 + i, rows[0][1], 1) for i in range(40)]  # copies: ties
    more += [(9300 + i, [x * 0.8 for x in rows[0][1]], 2) for i in range(30)]
    more += [(9400, [-x for x in rows[3][1]], 3), (10, rows[10][1], rows[10][2]), (20, rows[40][1], 0)]  # repeats
    return rows + [(*r, 1, "s") for r in more]


@pytest.mark.parametrize(("seed", "spread"), [(1, 1.0), (2, 0.2)])
def test_mine(spark, seed, spread):
    rows = edges(table(400, seed, spread))
    want = by_force(rows, 10)
    assert len(want) > 200
    assert mined(spark, rows, 10) == want
    assert mined(spark, rows, 10, n_pivots=2, sample=1, chunk=7) == want


def test_other_numbers(spark):
    rows = edges(table(200, 5))
    assert mined(spark, rows, 20, positives=2, negatives=6, scale=16) == by_force(rows, 20, 2, 6, 16)


def test_large_numbers(spark):
    """One long vector changes nothing for the others; scores beyond 64 bits are held within them."""
    rows = table(150, 7) + [(5000 + i, [float(x)] * 8, i % 2, 1, "s") for i, x in enumerate((1e6, 3e9, 1e15, -1e15, 1e30, 2e30, 3e38))]
    assert mined(spark, rows, 10) == by_force(rows, 10)


def test_empty(spark):
    assert mined(spark, [], 10) == [] and mined(spark, [(1, [1.0], 1, 1, "s")], 10) == [] and mined(spark, [(10, [1.0], 1, 1, "s")], 10) == []


def test_brackets():
    """No bracket leaves a score out, whatever the layer; near rows get narrow ones."""
    rng = np.random.default_rng(4)
    x = np.floor(256 * np.concatenate([rng.normal(size=(300, 8)), rng.normal(size=(5, 8)) * 1e5, np.zeros((1, 8))]))
    q, pivots = x[::10], x[[0, 7, 200]]
    s = N.Search((np.arange(len(q)), np.zeros(len(q)), q.astype(np.int64), np.zeros((len(q), 1), np.int64), np.zeros((len(q), 1), np.int64)), pivots, 1, True)
    layers = N.layer_of(x)
    assert len(set(layers.tolist())) > 2 and (4.0**layers >= (x * x).sum(axis=1)).all()
    for e in set(layers.tolist()):
        own = x[layers == e]
        far = N.reach(own, pivots, e, False)
        low, high = s.bracket(np.arange(len(q)), e, far, far)
        exact = q @ own.T
        assert (low <= exact).all() and (exact <= high).all()
        low, high = s.bracket(np.arange(len(q)), e, far.min(axis=0)[None], far.max(axis=0)[None])
        assert (low <= exact).all() and (exact <= high).all()
