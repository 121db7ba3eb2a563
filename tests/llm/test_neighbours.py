import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import neighbours
from shelfwise.llm.neighbours import balanced_parts, fit_model, nearest_neighbours

SCHEMA = "vec_id long, embedding array<double>, score string"


def exact(rows, k):
    """Ranked lists of every query row, by plain sums."""
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (i, v) in enumerate(fine):
        if i % 20:
            continue
        scored = [(-math.fsum(a * b for a, b in zip(v, w)), j) for b, (j, w) in enumerate(fine) if b != at and len(w) == len(v)]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return out


def search(spark, rows, k, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(6)
    got = nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=k, **more)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return [tuple(r) for r in got.collect()]


def recall(got, wanted):
    found, right = {(q, v) for q, _, v, _ in got}, {(q, v) for q, _, v, _ in wanted}
    return len(found & right) / len(right)


def clustered(n, length, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, length))
    points = centres[rng.integers(0, 30, n)] + 0.3 * rng.normal(size=(n, length))
    points[: n // 3] = points[0] + 1e-3 * rng.normal(size=(n // 3, length))  # a hot group
    return points


@pytest.mark.parametrize("kind", ["clusters", "uniform", "lengths"])
def test_recall_against_every_pair(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "SHARD", 300)
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    rng = np.random.default_rng(9)
    points = clustered(3000, 24, 8) if kind == "clusters" else rng.normal(size=(3000, 24))
    if kind != "clusters":
        points /= np.linalg.norm(points, axis=1, keepdims=True)
    if kind == "lengths":
        points *= rng.uniform(0.2, 2.0, (3000, 1))
    ids = rng.permutation(6000)[:3000].tolist()
    rows = [(int(i), p.tolist()) for i, p in zip(ids, points)]
    wanted = exact(rows, 10)
    got = search(spark, rows, 10)
    assert recall(got, wanted) >= 0.9
    ranks = {}
    for q, r, v, s in got:
        ranks.setdefault(q, []).append((r, -s, v))
    by_id = dict(rows)
    for q, found in ranks.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [x[1:] for x in found] == sorted(x[1:] for x in found)
        assert all(math.isclose(-s, math.fsum(a * b for a, b in zip(by_id[q], by_id[v])), rel_tol=1e-12) for _, s, v in found)


def test_clusters_need_few_parts():
    model = fit_model(clustered(4000, 24, 4)[4000 // 3 :], 16, 10, 0.95)
    assert model.route is not None and model.probes <= 8


def test_parts_are_balanced_and_keep_edges():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(1000, 2))
    near = np.argsort(((points[:, None] - points[None]) ** 2).sum(-1), axis=1)[:, 1:9]
    label = balanced_parts(near, 10, rng)
    assert np.bincount(label, minlength=10).max() <= math.ceil(neighbours.SLACK * 100)
    assert (label[near] == label[:, None]).mean() > 0.6


def test_odd_rows(spark):
    """Few rows are searched in full, so the answer is exact."""
    rows = [(i, [float(i % 7 - 3), 0.5, float(i % 3)]) for i in range(-20, 60)]
    rows += [(100, [1.0, 1.0, 1.0])] * 3 + [(100, [2.0, 0.0, 0.0]), (101, [1.0, 1.0, 1.0])]  # repeated rows and ids
    rows += [(None, [1.0] * 3), (120, None), (140, []), (160, [1.0, None, 1.0]), (180, [0.0, 0.0, 0.0])]
    rows += [(200, [float("nan"), 1.0, 1.0]), (220, [float("inf"), 1.0, 1.0])]
    rows += [(240, [1.0, 2.0]), (260, [3.0, 1.0]), (261, [3.0, 1.0]), (280, [1.0] * 5)]  # other lengths; the last is alone
    assert sorted(search(spark, rows, 5)) == sorted(exact(rows, 5))
    assert search(spark, [], 5) == []
    assert search(spark, [(20, [1.0])], 5) == []
    floats = spark.createDataFrame([(20, [0.1, 1.0]), (1, [0.1, 2.0])], "vec_id long, embedding array<float>")
    near = np.float32(0.1).astype(float)
    assert nearest_neighbours(floats, F.col("vec_id") % 20 == 0).collect()[0].score == near * near + 2.0
