import math
import random

import numpy as np
import pytest

from barloom.llm import topk


def brute(rows, queries, k=10):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)
    scaled = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = []
    for q, v in [(i, [math.floor(1024 * x) for x in v]) for i, v in queries if i is not None and usable(v)]:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in scaled if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, query_rows", [(16384, 4096), (40, 3)])
def test_against_brute_force(spark, monkeypatch, shard_rows, query_rows):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk, "QUERY_ROWS", query_rows)
    rng = random.Random(5)
    rows = [(k, [rng.choice([-1.0, -0.25, 0.0, 0.5, 1.0]) if k % 2 else rng.gauss(0, 1) for _ in range(6)]) for k in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6),
             (None, [1.0] * 6), (304, [1.0, 2.0]), (305, [3.0, 1.0]), (7, rows[7][1]), (50, [0.5] * 6)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, shard string")
    asked = [r for r in rows if r[0] is None or r[0] % 10 == 0 or r[0] == 305]
    queries = spark.createDataFrame([(i, v) for i, v in asked], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_inner_products(frame, queries).collect())
    assert got == brute(rows, asked)
    assert topk.top_inner_products(frame.filter("false"), queries.filter("false")).count() == 0


def test_equal_vectors_tie_to_smaller_ids_and_prune():
    ids = np.arange(1000)
    tree = topk.BallTree(ids, np.ones((1000, 4), np.int64))
    scores, found = tree.search(np.array([3]), np.ones((1, 4), np.int64), 5, np.array([-np.inf]))[0]
    assert found.tolist() == [0, 1, 2, 4, 5] and scores.tolist() == [4] * 5


def test_scores_beyond_64_bits_are_refused():
    tree = topk.BallTree(np.arange(2), np.full((2, 2), 2 ** 40))
    with pytest.raises(OverflowError):
        tree.search(np.array([9]), np.full((1, 2), 2 ** 40), 1, np.array([-np.inf]))
