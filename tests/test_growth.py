"""What keeps the cost of a growing pool down leaves the results as they are."""

import numpy as np
import pyarrow as pa

from winnow.operators import models, moments, pairs, selectors, setmetrics


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")


def test_groups_of_trees_are_one_forest(spark, monkeypatch):
    fitted = []

    class Recorded(models.RandomForestClassifier):
        def _fit(self, df):
            fitted.append((self.getNumTrees(), df.rdd.getNumPartitions()))
            return super()._fit(df)

    monkeypatch.setattr(models, "RandomForestClassifier", Recorded)
    monkeypatch.setattr(models, "TREES", 4)
    rng = np.random.default_rng(0)
    a, b = frame(spark, rng.normal(0, 1, (80, 3))), frame(spark, rng.normal(4, 1, (60, 3)))
    got = models.forest_rank(a, b, folds=2, trees=10, depth=3).collect()
    assert sorted(n for n, _ in fitted) == [2, 2, 4, 4, 4, 4] and {p for _, p in fitted} == {1}
    assert sorted(r["id"] for r in got) == list(range(60)) and np.mean([r["score"] for r in got]) > 0.9 and all(0 <= r["score"] < 1 + 1e-9 for r in got)


def test_near_by_floats_is_near_by_doubles():
    rng = np.random.default_rng(1)
    for y in (rng.normal(size=(700, 8)), rng.normal(size=(700, 8)) + 1e4, rng.integers(0, 3, (700, 3)).astype(float), rng.normal(size=(5, 8)), rng.normal(size=(700, 8)) * 1e25):
        block, x, ids = {"id": np.arange(len(y)) * 2, "x": y}, y[:40], np.arange(len(y))[:40] * 2
        exact = np.sqrt(np.square(x[:, None] - y[None]).sum(2))
        for own in (None, ids):
            d = exact.copy()
            if own is not None:
                d[np.arange(len(x)), np.arange(len(x))] = np.inf
            for k in (1, 4):
                rows, cols = pairs._in_doubt(x, block, k, own)
                found = set(zip(rows.tolist(), cols.tolist()))
                assert all((i, j) in found for i in range(len(x)) for j in np.lexsort((block["id"], d[i]))[:k].tolist())
                assert own is None or not any(i == j for i, j in found)


def test_unclustered_neighbours_leave_few_pairs_in_doubt():
    rng = np.random.default_rng(2)
    y = rng.normal(size=(5000, 64))
    rows, _ = pairs._in_doubt(y[:50], {"id": np.arange(5000), "x": y}, 5, np.arange(50))
    assert len(rows) <= 50 * 6


def test_coverage_of_few_candidates_needs_few_radii(spark, monkeypatch):
    rng = np.random.default_rng(3)
    ref = rng.normal(size=(600, 2))
    reference, sets = frame(spark, ref), {"mid": frame(spark, rng.normal(size=(2, 2)) * 0.3), "far": frame(spark, rng.normal(size=(5, 2)) + 9), "own": frame(spark, ref[:2], 1000)}
    want = {name: setmetrics.coverage_density(reference, df) for name, df in sets.items()}
    direct, asked, nearest = {}, [], pairs.nearest
    gap = np.sqrt(np.square(ref[:, None] - ref[None]).sum(2))
    radius = np.sort(gap, 1)[:, 5]
    for name, df in sets.items():
        x = np.array([r["x"] for r in df.collect()])
        n = (np.sqrt(np.square(ref[:, None] - x[None]).sum(2)) <= radius[:, None]).sum(1)
        direct[name] = {"coverage": round(float((n > 0).mean()), 4), "density": round(float(n.sum()) / (5 * len(x)), 4), "k": 5}

    def counted(left, right, *args, **kwargs):
        asked.append(left.count() * right.count())
        return nearest(left, right, *args, **kwargs)

    monkeypatch.setattr(setmetrics, "BALLS_OF", 64)
    monkeypatch.setattr(pairs, "nearest", counted)
    assert setmetrics.coverage_densities(reference, sets) == direct == want
    assert sum(asked) < 600 * 600 / 2


def test_a_task_works_on_few_rows_of_a_large_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000))], ["id"])
    parts = list(selectors._tiles([batch]))
    assert max(p.num_rows for p in parts) <= selectors.TILE and sum(p.num_rows for p in parts) == 10_000
    assert moments.ROWS * moments.WIDTH**2 / 2 * 8 <= 10 << 20
