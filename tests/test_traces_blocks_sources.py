"""Traces of selectors, blocks of vectors, gates in order, numbering, images and optional tables, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.test_selectors_gates import frame, herded, in_order, mixture

from winnow.functions import images
from winnow.operators import curation, gates, models, pairs, sampling, selectors, setmetrics
from winnow.plans import pipelines
from winnow.sources import manifests


def poly(a, b):
    return (a @ b.T / a.shape[1] + 1) ** 3


def test_herding_traces_its_distance_to_the_reference(spark, monkeypatch):
    real, pool = mixture(1, 60, [0.5, 0.3, 0.2]), mixture(2, 80, [1 / 3] * 3)
    for ahead, steps in ((512, 64), (3, 5), (1, 1)):  # wrong guesses cost rounds, not picks
        monkeypatch.setattr(selectors, "AHEAD", ahead)
        monkeypatch.setattr(selectors, "STEPS", steps)
        n = 12 if ahead == 512 else 6
        rows = selectors.herding(frame(spark, pool).repartition(5), frame(spark, real), n).orderBy("pick_no").collect()
        assert [r["id"] for r in rows] == herded(pool, real, n)
        for t, r in enumerate(rows, 1):
            s = pool[[x["id"] for x in rows[:t]]]
            assert r["mmd2"] == pytest.approx(poly(s, s).mean() + poly(real, real).mean() - 2 * poly(s, real).mean(), rel=1e-9)


def volume_picks(x, n, sigma, q):
    """The pick that makes the determinant largest, one after the other."""
    k = np.exp(-((x[:, None] - x) ** 2).sum(-1) / (2 * sigma**2)) * np.outer(q, q)
    out, dets = [], []
    for _ in range(n):
        value = [-np.inf if i in out else np.linalg.slogdet(k[np.ix_([*out, i], [*out, i])])[1] for i in range(len(x))]
        out.append(int(np.argmax(value)))
        dets.append(max(value))
    return out, dets


@pytest.mark.parametrize("steps", [64, 3])
def test_dpp_traces_the_log_determinant(spark, steps, monkeypatch):
    monkeypatch.setattr(selectors, "STEPS", steps)
    pool, real = mixture(4, 50, [1 / 3] * 3, 3.0), mixture(6, 30, [0.6, 0.2, 0.2])
    want, dets = volume_picks(pool, 8, 4.0, np.ones(50))
    rows = selectors.dpp(frame(spark, pool).repartition(4), 8, sigma=4.0)[0].orderBy("pick_no").collect()
    assert [r["id"] for r in rows] == want and np.allclose([r["logdet"] for r in rows], dets)
    q = np.exp(-((pool[:, None] - real) ** 2).sum(-1) / 32).mean(1)
    want, _ = volume_picks(pool, 8, 4.0, q / q.max())
    assert in_order(selectors.dpp(frame(spark, pool), 8, quality="real_affinity", reference=frame(spark, real), sigma=4.0)[0]) == want


def test_blocks_meet_in_spark_and_not_on_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(70, 4)), rng.normal(size=(90, 4))
    b[5] = a[3]
    monkeypatch.setattr(pairs, "BLOCK_BYTES", 500)
    monkeypatch.setattr(pairs, "CELLS", 40)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *_: pytest.fail("a broadcast"))
    l, r = frame(spark, a), frame(spark, b)
    d = np.sqrt(((a[:, None] - b) ** 2).sum(-1))
    near = pairs.nearest(l, r, 4).orderBy("id").collect()
    assert [[e["other"] for e in x["near"]] for x in near] == np.argsort(d, 1)[:, :4].tolist()
    assert near[3]["near"][0]["d"] == 0.0
    own = np.sqrt(((b[:, None] - b) ** 2).sum(-1))
    np.fill_diagonal(own, np.inf)
    radius = np.sort(own, 1)[:, 4]
    balls = pairs.radii(r, 5)
    assert np.allclose(balls.orderBy("id").toPandas()["radius"], radius)
    inside = {x["id"]: x["n"] for x in pairs.inside_counts(l, balls, radius_of="right").collect()}
    assert inside == {i: int((d[i] <= radius).sum()) for i in range(70)}
    inside = {x["id"]: x["n"] for x in pairs.inside_counts(balls, r).collect()}
    assert inside == {i: 6 for i in range(90)}  # itself and five neighbours, the farthest on the edge
    both = setmetrics.mmd2(l, r)
    off = lambda k: (k.sum() - np.trace(k)) / (len(k) * (len(k) - 1))
    assert both["biased"] == pytest.approx(poly(a, a).mean() + poly(b, b).mean() - 2 * poly(a, b).mean())
    assert both["unbiased"] == pytest.approx(off(poly(a, a)) + off(poly(b, b)) - 2 * poly(a, b).mean())


def test_a_costly_gate_sees_survivors_only(spark):
    seen = []
    pool = frame(spark, mixture(1, 40, [1 / 3] * 3))

    def gate(rest):
        def run(rows):
            seen.append(rows.count())
            return rows.select("id", (F.col("id") % rest != 0).alias("keep"))

        return run

    kept, counts = gates.in_order(pool, {"cheap": gate(2), "costly": gate(3)})
    assert seen == [40, 20] and counts == {"n_in": 40, "dropped_cheap": 20, "dropped_costly": 7, "n_kept": 13} and kept.count() == 13


def test_rows_are_numbered_in_order(spark):
    rows = spark.range(0, 5000, 7).repartition(9).withColumn("s", F.col("id") * 1.0)
    got = [(r["id"], r["row"]) for r in sampling.numbered(rows, "id").collect()]
    assert sorted(got) == [(7 * i, i) for i in range(len(got))]
    kept = {r["id"] for r in gates.chunk_quantile_gate(rows, "s", "id", 0.1, 100).where("keep").collect()}
    ids = np.arange(0, 5000, 7)
    assert kept == {int(v) for c in range(0, len(ids), 100) for v in ids[c : c + 100] if v > np.quantile(ids[c : c + 100], 0.1)}


def test_optional_lookup(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, score string")
    assert {r["score"] for r in curation.optional_lookup(rows, None, "k", {"score": "double"}).collect()} == {None}
    known = spark.createDataFrame([(1, 0.5), (1, 0.25), (9, 1.0)], "k long, score double")
    assert {r["k"]: r["score"] for r in curation.optional_lookup(rows, known, "k", {"score": "double"}).collect()} == {1: 0.25, 2: None, None: None}


def test_entropy_bounds_hold_what_was_cut():
    rng = np.random.default_rng(3)
    for _ in range(50):
        full = np.sort(rng.dirichlet(np.full(30, 0.3)))
        known = full * rng.uniform(0.5, 1, 30) * (rng.random(30) < 0.8)
        low, high = setmetrics.entropy_bounds(known[known > 0], 30)
        exact = -(full * np.log(np.maximum(full, 1e-300))).sum()
        assert low <= exact + 1e-12 and exact <= high + 1e-12 <= np.log(30) + 1e-9
    assert setmetrics.entropy_bounds(np.array([0.25, 0.75]), 2) == pytest.approx((0.5623351, 0.5623351))
    assert setmetrics.entropy_bounds(np.array([0.5]), 4)[1] == pytest.approx(-0.5 * np.log(0.5) - 0.5 * np.log(0.5 / 3))


def test_rbf_vendi_of_many_rows_lies_between_its_bounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 6))[rng.integers(12, size=600)] * 4 + rng.normal(size=(600, 6)) * 0.5
    exact = setmetrics.vendi_score(frame(spark, x), "rbf", 2.0)["vendi"]
    monkeypatch.setattr(setmetrics, "RBF_ROWS", 100)
    monkeypatch.setattr(setmetrics, "_ROWS", 70)
    widths = []
    for landmarks in (40, 150, 600):
        r = setmetrics.vendi_score(frame(spark, x).repartition(5), "rbf", 2.0, landmarks=landmarks)
        assert r["low"] - 1e-4 <= exact <= r["high"] + 1e-4 and r["low"] <= r["vendi"] <= r["high"] and r["n"] == 600
        widths.append(r["high"] / r["low"])
    assert widths[0] > widths[1] > widths[2] and widths[2] < 1.0002  # 150 landmarks: within 1.55, as each cluster has its own directions
    copies = setmetrics.vendi_score(frame(spark, np.repeat(x[:3], 60, 0)), "rbf", 1e-3)
    assert copies["low"] == pytest.approx(3, abs=1e-3) and copies["high"] == pytest.approx(3, abs=1e-3)


def test_rbf_vendi_of_a_hundred_thousand_rows(spark):
    many = spark.range(100_000).select("id", F.array(*(F.randn(i) for i in range(3))).alias("x"))
    r = setmetrics.vendi_score(many, "rbf", 2.0, landmarks=256)
    assert 1 < r["low"] <= r["high"] < 1.01 * r["low"] and r["n"] == 100_000


def test_parity_vendi_and_small_sets(spark):
    x = np.random.default_rng(1).normal(size=(30, 3))
    y = x.copy()
    y[4, 1] += 0.5
    r = setmetrics.feature_parity(frame(spark, x), frame(spark, y))
    assert r["n"] == 30 and r["max_difference"] == pytest.approx(0.5) and r["min_cosine"] < 1
    k = np.exp(-((x[:, None] - x) ** 2).sum(-1) / 2) / 30
    w = np.maximum(np.linalg.eigvalsh(k), 1e-12)
    assert setmetrics.vendi_score(frame(spark, x), "rbf", 1.0)["vendi"] == pytest.approx(np.exp(-(w * np.log(w)).sum()), abs=1e-3)
    with pytest.raises(ValueError):
        setmetrics.vendi_score(frame(spark, x), "other")
    assert np.isnan(setmetrics.kid(frame(spark, x), frame(spark, x[:1]))["kid"])


def test_inception_score_of_certain_and_unsure_models(spark):
    sure = spark.createDataFrame([(i, [float(i % 4 == c) for c in range(4)]) for i in range(400)], "id long, p array<double>")
    unsure = spark.createDataFrame([(i, [0.25] * 4) for i in range(400)], "id long, p array<double>")
    assert 3.5 < setmetrics.inception_score(sure)[0] <= 4.0 and setmetrics.inception_score(unsure)[0] == pytest.approx(1.0)


def test_linear_probe_against_gradient_steps(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=120) > 0).astype(int)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(120)], "id long, x array<double>, y int")
    p = models.linear_probe(rows, rows).orderBy("id").toPandas()["p"].to_numpy()
    one, w = np.hstack([x, np.ones((120, 1))]), np.zeros(4)
    pen = np.array([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-one @ w))
        w += np.linalg.solve((one * (q * (1 - q))[:, None]).T @ one + np.diag(pen), one.T @ (y - q) - pen * w)
    assert np.allclose(p, 1 / (1 + np.exp(-one @ w)), atol=1e-3)


def test_grey_resized_and_damaged_images(spark):
    colour = np.zeros((2, 2, 3), np.uint8)
    colour[..., 1] = 100
    assert images.grey(colour).tolist() == [[59, 59], [59, 59]] and images.grey(colour[..., 0]).shape == (2, 2)
    ramp = np.tile(np.arange(8, dtype=np.uint8) * 10, (4, 1))
    assert images.resized(ramp, 4, 8).tolist() == ramp.tolist() and images.resized(ramp, 2, 4, "bilinear")[0].tolist() == [7, 25, 45, 63]
    assert images.bounding_box(np.zeros((4, 5), bool)) == (0, 3, 0, 4)

    def decode(raw):
        if not raw.endswith(b"\xff\xd9"):
            raise ValueError("cut")
        return np.frombuffer(raw[2:6], np.uint8).reshape(2, 2)

    files = spark.createDataFrame([(1, b"\xff\xd8abcd\xff\xd9"), (2, b"\xff\xd8abcd"), (3, b"none"), (4, None)], "i int, content binary")
    got = {r["i"]: r["m"] for r in files.select("i", manifests.tolerant(decode)("content").alias("m")).collect()}
    assert got[1]["px"] == [97, 98, 99, 100] and not got[1]["truncated"] and got[2]["px"] == got[1]["px"] and got[2]["truncated"]
    assert got[3]["px"] is None and got[4]["px"] is None


def test_images_of_a_manifest(spark, tmp_path):
    for name in ("a/1.png", "a/2.png", "a/3.png", "b/4.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    rows = [("s", "t", "d", "train", "1.0", "a/1.png"), ("s", "t", "d", "train", "1.0", "a/2.png"), ("s", "t", "d", "test", "1.0", "a/3.png"), ("s", "t", "d", "train", "0.0", "b/4.png"), ("s", "t", "d", "train", "0.0", "b/gone.png"), ("s", "t", "d", "train", None, "a/3.png")]
    manifest = spark.createDataFrame(rows, manifests.MANIFEST)
    as_text = F.pandas_udf(lambda c: c.map(lambda b: bytes(b).decode()), "string")
    got = manifests.images_of(spark, manifest, str(tmp_path), "train", "good", "normal", as_text, 1).collect()
    assert {(r["cls"], r["image"]) for r in got} == {("good", "a/1.png"), ("normal", "b/4.png")}


def test_comparisons_of_selections(spark):
    real, pool = frame(spark, mixture(1, 40, [0.5, 0.3, 0.2])), frame(spark, mixture(2, 40, [1 / 3] * 3))
    grid = pipelines.ablation(pool, real, 6, ("kcenter", "random"), {"none": {"realism": None}, "memorisation": {"memorisation": 5, "realism": None}}, subset_size=5, subsets=4).collect()
    assert {r["name"] for r in grid} == {f"{s}+{g}" for s in ("kcenter", "random") for g in ("none", "memorisation")} and {r["n"] for r in grid} == {6}
    turned = frame(spark, mixture(2, 40, [1 / 3] * 3)[:, ::-1])
    one = pipelines.scored_elsewhere({"x": selectors.random_pick(pool, 6)}, turned, real, subset_size=5, subsets=4).first()
    assert one["n"] == 6
    d = gates.Pca(real, 2).mahalanobis(pool).orderBy("d", "id").select("id").limit(36)
    assert set(in_order(pipelines.nearest_then_herd(pool, real, 5, k=2))) <= {r["id"] for r in d.collect()}
