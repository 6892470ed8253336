"""Exact quantiles over many ranks and groups, and thresholds by class, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import gates, quantiles

VALUES = [0.0, -0.0, 1e300, -1e300, 1e-310, -5e-324, float("inf"), float("-inf"), 3.5, 3.5, 3.5, -2.25, 1e-5, None, float("nan")]


@pytest.mark.parametrize("few", [1 << 16, 2])
def test_order_statistics_of_all_ranks(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)  # with 2, all passes are made
    rng = np.random.default_rng(1)
    values = VALUES + rng.normal(0, 1, 200).tolist() + [7.0] * 40
    kept = sorted(v for v in values if v is not None and not np.isnan(v))
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert quantiles.order_statistics(df, "v", list(range(len(kept)))) == kept
    finite = [v for v in kept if np.isfinite(v) and abs(v) < 1e200]
    some = df.where("abs(v) < 1e200")
    assert quantiles.quantile(some, "v", 0.37) == pytest.approx(np.quantile(finite, 0.37), rel=1e-12)
    assert quantiles.lower_median(some, "v") == finite[(len(finite) - 1) // 2]
    assert quantiles.quantile(df.where("v is null"), "v", 0.5) is None and quantiles.lower_median(df.limit(0), "v") is None


@pytest.mark.parametrize("few", [1 << 16, 3])
def test_quantiles_of_groups_at_once(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(0, 1, 300), "b": rng.exponential(5, 77), None: np.array([2.0, 2.0, 9.0]), "one": np.array([4.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None)], "cls string, v double")
    qs = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(r["cls"], r["q"]): r["value"] for r in quantiles.quantiles(df, "v", qs, ["cls"]).collect()}
    assert got == {(g, q): pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-12) for g, vs in groups.items() for q in qs}


def test_passes_do_not_depend_on_the_ranks(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 2)
    df = spark.range(2000).select(F.sqrt("id").alias("v"))
    passes = []
    real = quantiles._met
    monkeypatch.setattr(quantiles, "_met", lambda *a: passes.append(1) or real(*a))
    for ranks in ([5], list(range(0, 2000, 9))):
        passes.clear()
        assert quantiles.order_statistics(df, "v", ranks) == [np.sqrt(r) for r in ranks]
        assert len(passes) <= 4


def classes(rng, n, centre, spread):
    return centre + rng.normal(0, 1, (n, 5)) @ (np.eye(5) * spread)


def plain_distances(real, pool, k):
    mean, cov = real.mean(0), np.cov(real.T)
    w, v = np.linalg.eigh(cov)
    k = min(k, len(w), len(real) - 1)
    comp, std = v[:, ::-1][:, :k], np.sqrt(np.maximum(w[::-1][:k], 0) * (len(real) - 1) / len(real)) + 1e-6
    return np.sqrt(((((pool - mean) @ comp) / std) ** 2).sum(1))


def test_reference_threshold_of_each_class_and_of_all(spark):
    rng = np.random.default_rng(4)
    real = {"a": classes(rng, 120, 0.0, [1, 2, 3, 1, 1]), "b": classes(rng, 90, 8.0, [0.2, 1, 1, 5, 1])}
    pool = {"a": classes(rng, 60, 0.5, [1, 2, 3, 2, 1]), "b": classes(rng, 50, 8.2, [0.3, 1, 1, 5, 2])}

    def frame(sets):
        rows = [(1000 * c + i, cls, v.tolist()) for c, (cls, x) in enumerate(sets.items()) for i, v in enumerate(x)]
        return spark.createDataFrame(rows, "id long, cls string, x array<double>")

    got = {r["id"]: (r["d"], r["keep"], r["threshold"]) for r in gates.class_threshold_gate(frame(pool), frame(real), "cls", 95, 3).collect()}
    for c, cls in enumerate(pool):
        want, own = plain_distances(real[cls], pool[cls], 3), plain_distances(real[cls], real[cls], 3)
        for i, d in enumerate(want):
            assert got[1000 * c + i][0] == pytest.approx(d, rel=1e-9) and got[1000 * c + i][1] == (d <= np.quantile(own, 0.95))
            assert got[1000 * c + i][2] == pytest.approx(np.quantile(own, 0.95), rel=1e-9)
    one = {r["id"]: (r["d"], r["keep"]) for r in gates.reference_threshold_gate(frame(pool).where("cls = 'a'"), frame(real).where("cls = 'a'"), 95, 3).collect()}
    assert one == {i: (pytest.approx(got[i][0], rel=1e-12), got[i][1]) for i in one} and len(one) == 60


def test_classes_without_a_reference_are_left_out(spark):
    real = spark.createDataFrame([(i, "a", [float(i % 3), float(i % 5)]) for i in range(20)], "id long, cls string, x array<double>")
    pool = spark.createDataFrame([(1, "a", [1.0, 1.0]), (2, "b", [1.0, 1.0]), (3, None, [0.0, 0.0])], "id long, cls string, x array<double>")
    assert [(r["id"], r["keep"]) for r in gates.class_threshold_gate(pool, real, "cls", 95, 2).collect()] == [(1, True)]
    assert gates.class_threshold_gate(pool.limit(0), real, "cls").count() == 0
