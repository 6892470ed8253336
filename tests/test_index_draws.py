"""The metric index, seeded draws and moments against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import moments, pairs, sampling, setmetrics


def clustered(rng, n, centres, d=8, spread=0.05):
    return centres[rng.integers(0, len(centres), n)] + rng.normal(0, spread, (n, d))


def frame(spark, x, first=0, radius=None):
    rows = [(first + i, [float(e) for e in v], *([] if radius is None else [float(radius[i])])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>" + ("" if radius is None else ", radius double"))


@pytest.fixture
def sets(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 5, (40, 8))
    a, b = clustered(rng, 250, centres), clustered(rng, 400, centres)
    b[:5], b[5:8] = b[5], a[:3]  # ties, and distances of 0
    return a, b


def brute(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))


@pytest.mark.parametrize("k", [1, 6])
def test_neighbours_by_cells_equal_brute_force(spark, sets, monkeypatch, k):
    monkeypatch.setattr(pairs, "BLOCK_BYTES", 1200)
    a, b = sets
    got = {r["id"]: [(p["d"], p["other"]) for p in r["near"]] for r in pairs.nearest(frame(spark, a), frame(spark, b), k).collect()}
    d = brute(a, b)
    for i in range(len(a)):
        by = np.lexsort((np.arange(len(b)), d[i]))[:k]
        assert [o for _, o in got[i]] == by.tolist()
        assert np.allclose([x for x, _ in got[i]], d[i][by], atol=1e-12)
    own = {r["id"]: r["radius"] for r in pairs.radii(frame(spark, b), k).collect()}
    dd = brute(b, b)
    np.fill_diagonal(dd, np.inf)
    assert np.allclose([own[i] for i in range(len(b))], np.sort(dd, 1)[:, k - 1], atol=1e-12)


def test_balls_by_cells_equal_brute_force(spark, sets, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_BYTES", 1200)
    a, b = sets
    rng = np.random.default_rng(5)
    ra, rb = rng.uniform(0, 0.4, len(a)), rng.uniform(0, 0.4, len(b))
    got = {r["id"]: r["n"] for r in pairs.inside_counts(frame(spark, a, radius=ra), frame(spark, b)).collect()}
    assert [got[i] for i in range(len(a))] == (brute(a, b) <= ra[:, None]).sum(1).tolist()
    got = {r["id"]: r["n"] for r in pairs.inside_counts(frame(spark, a), frame(spark, b, radius=rb), "right").collect()}
    assert [got[i] for i in range(len(a))] == (brute(a, b) <= rb[None]).sum(1).tolist()


def test_triangle_inequality_skips_most_cells(spark, sets, monkeypatch):
    """Of clustered vectors, over four of five pairs of a left vector and a block are skipped; of vectors in one cloud, results are right all the same."""
    monkeypatch.setattr(pairs, "BLOCK_BYTES", 2600)
    a, b = sets
    visited = []
    real = pairs._needed
    monkeypatch.setattr(pairs, "_needed", lambda *args: visited.append(real(*args)) or visited[-1])
    pairs.nearest(frame(spark, a), frame(spark, b), 1).count()
    blocks = len(visited[0])
    assert blocks > 20 and sum(v.sum() for v in visited) < 0.2 * len(a) * blocks
    cloud = np.random.default_rng(8).normal(0, 1, (120, 8))
    got = {r["id"]: r["near"][0]["d"] for r in pairs.nearest(frame(spark, cloud), frame(spark, cloud), 1, skip_same=True).collect()}
    d = brute(cloud, cloud)
    np.fill_diagonal(d, np.inf)
    assert np.allclose([got[i] for i in range(len(cloud))], d.min(1), atol=1e-12)


def test_one_cell_that_holds_most_vectors_is_split(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_BYTES", 1200)
    same = np.zeros((300, 8))
    same[-3:] = [[9.0] * 8, [9.5] * 8, [-4.0] * 8]
    cells = pairs.cells_of(frame(spark, same), 16)
    assert cells.count.sum() == 300 and cells.parts.max() > 5
    got = pairs.nearest(frame(spark, same), frame(spark, same, 1000), 2).collect()
    assert len(got) == 300 and all(r["near"][0]["d"] == 0 for r in got)


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_moments_equal_the_loop_over_pairs(spark, sets, degree):
    a, b = sets
    k = lambda x, y: (x @ y.T / x.shape[1] + 1) ** degree
    r = setmetrics.mmd2(frame(spark, a), frame(spark, b), degree=degree)
    off = lambda m: (m.sum() - np.trace(m)) / (len(m) * (len(m) - 1))
    want = {"biased": k(a, a).mean() + k(b, b).mean() - 2 * k(a, b).mean(), "unbiased": off(k(a, a)) + off(k(b, b)) - 2 * k(a, b).mean()}
    scale = k(a, a).mean()
    assert all(abs(r[c] - v) <= 1e-9 * scale for c, v in want.items())
    means = {x["id"]: x["mean"] for x in pairs.kernel_means(frame(spark, a), frame(spark, b), "poly", degree).collect()}
    assert np.allclose([means[i] for i in range(len(a))], k(a, b).mean(1), rtol=1e-9)


def test_moments_leave_other_kernels_to_the_loop(spark, sets, monkeypatch):
    a, b = sets
    loop = {r["id"]: r["s"] for r in pairs.kernel_sums(frame(spark, a), frame(spark, b)).collect()}
    assert np.allclose([loop[i] for i in range(len(a))], ((a @ b.T / 8 + 1) ** 3).sum(1), rtol=1e-9)
    assert not moments.fits(64, 4) and not moments.fits(2048, 3) and moments.fits(64, 3)
    monkeypatch.setattr(moments, "WIDTH", 4)
    by_loop = setmetrics.mmd2(frame(spark, a), frame(spark, b))
    monkeypatch.setattr(moments, "WIDTH", 96)
    by_moments = setmetrics.mmd2(frame(spark, a), frame(spark, b))
    assert all(abs(by_loop[c] - by_moments[c]) <= 1e-9 * loop[0] for c in by_loop)
    none = frame(spark, a).limit(0)
    assert np.isnan(setmetrics.mmd2(frame(spark, a), none)["biased"]) and pairs.kernel_means(frame(spark, a), none).count() == 0


def test_draws_are_the_first_of_each_order(spark, monkeypatch):
    import hashlib

    df = spark.range(700).withColumn("x", F.array(F.col("id").cast("double")))
    got = {}
    for r in sampling.subset_draws(df, 7, 20, "5r").collect():
        assert r["x"] == [r["id"]]
        got.setdefault(r["subset"], set()).add(r["id"])
    key = lambda s, i: hashlib.md5(f"5r:{s}:{i}".encode()).hexdigest()
    assert got == {s: set(sorted(range(700), key=lambda i: key(s, i))[:20]) for s in range(7)}
    assert sampling.subset_draws(df.limit(5), 3, 20).count() == 15


def test_draws_move_only_what_is_drawn(spark):
    """The ids that leave a task are about ``size`` a subset, not all of them; vectors aren't shuffled."""
    df = spark.range(20_000).withColumn("x", F.array(F.col("id").cast("double")))
    drawn = sampling.subset_draws(df, 5, 50)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert drawn.count() == 250
