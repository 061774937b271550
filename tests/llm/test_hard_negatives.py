import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, key long, rank int, vector string"


def made(seed, n=300, huge=1.0):
    """Vectors with many equal scores, of several lengths, with nulls, repeated and null ids."""
    rnd, rows = random.Random(seed), []
    for i in range(n):
        v = [rnd.choice([-1.0, 0.0, 0.5, 1.0, 3.0]) + rnd.choice([0.0, 0.0, 0.01]) for _ in range(rnd.choice([0, 3, 4, 4, 4]))]
        if v and huge > 1 and i % 9 == 0:
            v[0] *= huge
        if v and rnd.random() < 0.05:
            v[0] = rnd.choice([None, math.nan, math.inf])
        own = rnd.choice([None, 0, 100, 200, -100, *range(300)]) if rnd.random() < 0.3 else i
        rows.append((own, None if rnd.random() < 0.05 else v, rnd.choice([None, *range(4)]), 1, 2, "x"))
    return rows


def brute(rows):
    fine = [(i, v, y) for i, v, y, *_ in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(256 * x) for x in v] + [0] * (4 - len(v)) for _, v, _ in fine]
    out, last = [], 2**63
    for a, (i, _, y) in enumerate(fine):
        if i is None or i % 100:
            continue
        rank = sorted((-sum(p * q for p, q in zip(whole[a], x)), last if j is None else j, b) for b, ((j, *_), x) in enumerate(zip(fine, whole)))
        for score, positive, _ in [r for r in rank if r[2] != a and fine[r[2]][2] == y][:5]:
            window = [(n, j) for n, j, b in rank if fine[b][2] != y and 80 * -score <= 100 * -n <= 100 * -score][:5]
            known = lambda j: None if j == last else j
            out += [(i, known(positive), k, known(j), -score, -n) for k, (n, j) in enumerate(window, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "huge"), [(1, 1.0), (2, 1e5), (3, 1.5e6)])  # 32-bit floats, 64-bit floats, whole numbers
def test_against_brute_force(spark, seed, huge):
    rows = made(seed, huge=huge)
    df, want = spark.createDataFrame(rows, SCHEMA), brute(rows)
    assert len(want) > 5
    for kw in ({}, {"leaf": 4, "tree_bytes": 8 * 4 * 60, "block": 3}):
        got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **kw)
        assert sorted(map(tuple, got.collect()), key=str) == want
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_nothing_to_mine(spark):
    some = spark.createDataFrame([(1, [1.0], 1, 1, 1, "x"), (None, [1.0], 1, 1, 1, "x"), (100, None, 1, 1, 1, "x")], SCHEMA)
    for df in (some, some.limit(0)):
        assert hard_negatives.mine(df, F.col("vec_id") % 100 == 0).count() == 0


def test_a_score_past_64_bits_is_an_error(spark):
    df = spark.createDataFrame([(0, [1e10], 1, 1, 1, "x"), (1, [1e10], 1, 1, 1, "x")], SCHEMA)
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine(df, F.col("vec_id") % 100 == 0).count()


def test_trees_hold_their_rows_and_prune():
    """Each node's ball holds its rows; clusters far from the anchor are never scored."""
    rnd = np.random.default_rng(4)
    x = np.floor(np.concatenate([rnd.normal(c, 4, (300, 6)) for c in (0, 200, -200, 400)]))
    labels = rnd.integers(0, 3, len(x))
    order, nodes = hard_negatives.build(x, labels, 16)
    assert sorted(order) == list(range(len(x)))
    for first, past, _, low, high, radius, centre in nodes:
        own = x[order[first:past]]
        assert (np.sqrt(((own - centre) ** 2).sum(1)) <= radius + 1e-6).all()
        assert (low, high) == (labels[order[first:past]].min(), labels[order[first:past]].max())
    scored = []

    class Counting(hard_negatives.Search):
        def _leaf(self, a, score, *rest):
            scored.append(score.size)
            super()._leaf(a, score, *rest)

    first, past, skip, low, high, radius = ([n[i] for n in nodes] for i in range(6))
    tree = {
        "tree": 0, "dims": 6, "width": 2, "reach": float(np.sqrt((x**2).sum(1)).max()), "ids": list(range(len(x))), "labels": labels[order].tolist(),
        "vectors": x[order].astype(np.int16).tobytes(), "first": first, "past": past, "skip": skip, "low": low, "high": high, "radius": radius,
        "centres": np.concatenate([n[6] for n in nodes]).tolist(),
    }
    q = np.full((1, 6), 200)
    top = np.sort(x[order] @ q[0])[::-1]
    window = np.array([[0]]), np.array([[int(top[400])]])  # beneath the far cluster
    s = Counting(np.array([-1]), np.array([7]), q, *window, 5, False)
    s.visit(tree)
    inside = sorted((int(v) for v in x[order] @ q[0] if 0 <= v <= window[1][0, 0]), reverse=True)[:5]
    assert s.score[0, 0].tolist() == inside and sum(scored) < len(x) / 2
