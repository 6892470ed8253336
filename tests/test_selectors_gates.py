"""Selectors, gates, set metrics and fitted models against numpy and known properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import gates, models, pairs, report, sampling, selectors, setmetrics
from winnow.plans import pipelines

CENTRES = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]])


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")


def mixture(seed, n, weights, scale=1.0):
    rng = np.random.default_rng(seed)
    return CENTRES[rng.choice(3, n, p=weights)] + rng.normal(0, scale, (n, 2))


def herded(pool, real, n):
    """The greedy rule, one pick after the other."""
    k = lambda a, b: (a @ b.T / a.shape[1] + 1) ** 3
    a, own, b, out = k(pool, real).mean(1), np.array([k(p[None], p[None])[0, 0] for p in pool]), np.zeros(len(pool)), []
    for t in range(n):
        score = a - (b + 0.5 * own) / (t + 1)
        score[out] = -np.inf
        out.append(int(np.argmax(score)))
        b += k(pool, pool[out[-1:]])[:, 0]
    return out


def in_order(picks):
    return [r["id"] for r in picks.orderBy("pick_no").collect()]


def test_herding_equals_the_rule_on_vectors_of_any_length(spark):
    real, pool = mixture(1, 60, [0.5, 0.3, 0.2]), mixture(2, 80, [1 / 3] * 3)
    assert in_order(selectors.herding(frame(spark, pool), frame(spark, real), 10)) == herded(pool, real, 10)


def test_herding_follows_the_proportions_and_beats_chance(spark):
    real, pool = mixture(0, 200, [0.5, 0.3, 0.2], 0.5), mixture(5, 200, [1 / 3] * 3, 0.5)
    unit = 10.0  # rbf bandwidth that tells the centres apart
    p, r = frame(spark, pool), frame(spark, real)
    at = np.array(in_order(selectors.herding(p, r, 30, kernel="rbf", sigma=unit / 3)))
    near = ((pool[at][:, None] - CENTRES) ** 2).sum(-1).argmin(1)
    assert np.abs(np.bincount(near, minlength=3) / 30 - [0.5, 0.3, 0.2]).max() < 0.12
    chosen, chance = p.where(F.col("id").isin(at.tolist())), sampling.sample_n(p, 30, 1)
    mmd = lambda s: setmetrics.mmd2_biased(s, r, name="rbf", sigma=unit / 3)
    assert mmd(chosen) < 0.5 * mmd(chance)


def test_kcenter_takes_the_farthest(spark):
    pool = mixture(3, 60, [1 / 3] * 3)
    got = in_order(selectors.kcenter(frame(spark, pool), 6))
    for t in range(1, 6):
        d = np.sqrt(((pool[:, None] - pool[got[:t]]) ** 2).sum(-1)).min(1)
        assert d[got[t]] == pytest.approx(d.max())


def test_dpp_avoids_duplicates_and_fills_up_by_quality(spark):
    rng = np.random.default_rng(2)
    pool = np.concatenate([np.zeros((20, 2)), rng.normal(0, 2, (20, 2))])
    picks, ended = selectors.dpp(frame(spark, pool), 10, sigma=1.0)
    assert sum(i < 20 for i in in_order(picks)) <= 2 and not ended
    same = spark.createDataFrame([(i, [1.0, 1.0], float(i)) for i in range(6)], "id long, x array<double>, q double")
    picks, ended = selectors.dpp(same, 4, quality="q", sigma=1.0)
    assert in_order(picks) == [5, 4, 3, 2] and list(ended.values()) == [1]
    with pytest.raises(ValueError):
        selectors.dpp(same.withColumn("q", F.lit(-1.0)), 2, quality="q", sigma=1.0)


def test_selectors_by_class_and_too_few_rows(spark):
    pool = frame(spark, mixture(4, 40, [1 / 3] * 3)).withColumn("c", F.col("id") % 2)
    real = frame(spark, mixture(6, 30, [0.6, 0.2, 0.2])).withColumn("c", F.col("id") % 2)
    picks = selectors.herding(pool, real, 5, cls="c")
    for c in (0, 1):
        alone = selectors.herding(pool.where(F.col("c") == c), real.where(F.col("c") == c), 5)
        assert in_order(picks.where(F.col("c") == c)) == in_order(alone)
    with pytest.raises(ValueError):
        selectors.kcenter(pool, 30, cls="c")
    with pytest.raises(ValueError):
        selectors.select("no such", pool, real, 3)


def test_pixel_and_anatomy_gates(spark):
    from winnow.functions import images

    rng = np.random.default_rng(0)
    kinds = [rng.integers(40, 210, (32, 32)), np.full((32, 32), 128), np.full((32, 32), 255), rng.integers(30, 220, (32, 32))]
    rows = spark.createDataFrame([(i, [int(v) for v in k.ravel()], 32, 32, [0.5, 6.0, 5.0, 0.01][i]) for i, k in enumerate(kinds)], "id long, px array<short>, h int, w int, realism double")
    m = rows.withColumn("m", images.pixel_stats_udf("px", "h", "w")).withColumn("keep", gates.validity(F.col("m.std"), F.col("m.rails")))
    assert [r["keep"] for r in m.orderBy("id").collect()] == [True, False, False, True]
    strict = m.withColumn("keep", gates.validity(F.col("m.std"), F.col("m.rails"), F.col("realism"), F.lit(0.1)))
    assert [r["keep"] for r in strict.orderBy("id").collect()] == [True, False, False, False]
    areas = spark.createDataFrame([(0.01, 0.1, 0.1), (0.001, 0.1, 0.1), (0.01, 0.7, 0.1), (None, None, None)], "h double, l double, r double")
    assert [r[0] for r in areas.select(gates.anatomy(F.col("h"), F.col("l"), F.col("r"))).collect()] == [True, False, False, True]
    dark = np.zeros((40, 60), np.uint8)
    dark[10:30, 20:50] = 200
    assert images.crop_box(dark) == (8, 31, 18, 51)
    assert images.row_extent(dark) == 30 and images.width_ratio(dark[:, :35], dark) == 0.5


def test_gates_and_their_report(spark):
    real, pool = mixture(1, 60, [0.5, 0.3, 0.2]), mixture(2, 50, [1 / 3] * 3)
    pool[:3] = real[:3]  # copies
    p, r = frame(spark, pool), frame(spark, real)
    memo, info = gates.memorisation_gate(p, r, 5)
    assert info["n_in"] == 50 and {row["id"] for row in memo.where("not keep").collect()} >= {0, 1, 2}
    marked, counts = gates.compose(p, {"memorisation": memo, "realism": gates.realism_gate(p, r, 0.1, 3.0)})
    assert counts["dropped_memorisation"] == info["n_dropped"] and counts["n_kept"] == marked.where("keep").count() < 50
    d = gates.Pca(r, 2).mahalanobis(p).select("id", "d").orderBy("id").toPandas()["d"].to_numpy()
    centred = real - real.mean(0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    z = (pool - real.mean(0)) @ v.T / (s / np.sqrt(len(real)) + 1e-6)
    assert np.allclose(d, np.sqrt((z**2).sum(1)), rtol=1e-6)
    assert gates.mahalanobis_gate(p, r, 0.1, 2).where("keep").count() == 45
    picks, counts = pipelines.gated_selection(p, r, 5, memorisation=5, realism=None, mahalanobis=0.1)
    assert picks.count() == 5 and not {0, 1, 2} & set(in_order(picks))
    with pytest.raises(ValueError):
        pipelines.gated_selection(p, r, 50, memorisation=5)


def test_coverage_recall_and_vendi(spark):
    rng = np.random.default_rng(7)
    real = rng.normal(size=(120, 8))
    near, far = frame(spark, real + rng.normal(0, 0.01, real.shape)), frame(spark, real + 50)
    r = frame(spark, real)
    assert setmetrics.coverage_density(r, near)["coverage"] > 0.9 and setmetrics.coverage_density(r, far)["coverage"] < 0.1
    assert setmetrics.recall(r, near)["recall"] > 0.9 and setmetrics.recall(r, far)["recall"] == 0
    assert setmetrics.vendi_score(frame(spark, np.ones((20, 5))))["vendi"] == pytest.approx(1.0, abs=1e-3)
    assert setmetrics.vendi_score(frame(spark, np.eye(12)))["vendi"] == pytest.approx(12.0, abs=1e-3)


def test_frechet_distance_and_kid_equal_numpy(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(90, 4)), rng.normal(0.5, 1.3, (70, 4))
    ca, cb = np.cov(a.T) + 1e-6 * np.eye(4), np.cov(b.T) + 1e-6 * np.eye(4)
    cross = np.sqrt(np.linalg.eigvals(ca @ cb).real.clip(0)).sum()
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * cross
    assert setmetrics.frechet_distance(frame(spark, a), frame(spark, b)) == pytest.approx(want, rel=1e-6)
    k = lambda x, y: (x @ y.T / 4 + 1) ** 3
    off = lambda m: (m.sum() - np.trace(m)) / (len(m) * (len(m) - 1))
    want = off(k(a, a)) + off(k(b, b)) - 2 * k(a, b).mean()
    assert setmetrics.mmd2_unbiased(frame(spark, b), frame(spark, a)) == pytest.approx(want, rel=1e-9)
    got = setmetrics.kid(frame(spark, a), frame(spark, b), 70, 3)
    assert got["subset_size"] == 70 and got["kid"] == pytest.approx(want, rel=0.3)


def test_pairs_in_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(30, 3)), rng.normal(size=(40, 3))
    monkeypatch.setattr(pairs, "BLOCK_BYTES", 200)
    d = np.sqrt(((a[:, None] - b) ** 2).sum(-1))
    near = pairs.nearest(frame(spark, a), frame(spark, b), 3).orderBy("id").collect()
    assert [[e["other"] for e in r["near"]] for r in near] == np.argsort(d, 1)[:, :3].tolist()
    means = pairs.kernel_means(frame(spark, a), frame(spark, b)).orderBy("id").toPandas()["mean"].to_numpy()
    assert np.allclose(means, ((a @ b.T / 3 + 1) ** 3).mean(1))
    assert pairs.nearest(frame(spark, a), frame(spark, b[:0])).count() == 0


def test_models(spark):
    rng = np.random.default_rng(10)
    real, same, other = (frame(spark, x) for x in (rng.normal(size=(60, 3)), rng.normal(size=(60, 3)), rng.normal(3, 1, (60, 3))))
    assert models.c2st(real, other, trees=10, depth=4) > 0.9 > 0.75 > models.c2st(real, same, trees=10, depth=4)
    assert np.isnan(models.c2st(real.limit(5), same))
    picked = models.kmeans_balanced(real, 20, 4)
    assert picked.count() == 20 and picked.select("id").distinct().count() == 20
    scores = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "s double, y int")
    r = models.binary_report(scores, "s", "y").first()
    assert (r["auroc"], r["tp"], r["fp"], r["tn"], r["fn"]) == (0.875, 2, 1, 1, 0)
    assert models.binary_report(scores.where("y = 1"), "s", "y").first()["auroc"] is None


def test_reports(spark):
    old = spark.createDataFrame([(0, 1.0), (1, 2.0)], "gen int, a double")
    new = spark.createDataFrame([(1, None, 5.0), (2, 3.0, 6.0)], "gen int, a double, b double")
    merged = [tuple(r) for r in report.upsert_merge(old, new, "gen").orderBy("gen").collect()]
    assert merged == [(0, 1.0, None), (1, 2.0, 5.0), (2, 3.0, 6.0)]
    replaced = [tuple(r) for r in report.upsert_replace(old, new, "gen").orderBy("gen").collect()]
    assert replaced == [(0, 1.0, None), (1, None, 5.0), (2, 3.0, 6.0)]
    assert [r["a_delta"] for r in report.delta_vs_first(old, "gen", ["a"]).orderBy("gen").collect()] == [0.0, 1.0]
    docs = spark.createDataFrame([("x", '{"fd": 1.5, "kid": 0.1}')], "name string, m string")
    assert sorted((r["key"], r["value"]) for r in report.explode_metrics(docs, "m").collect()) == [("fd", 1.5), ("kid", 0.1)]
    lines = [r["line"] for r in report.markdown(old, ["gen", "a"], "gen").orderBy("line_no").collect()]
    assert lines == ["| gen | a |", "|---|---|", "| 0 | 1.0 |", "| 1 | 2.0 |"]
