"""Manifests, flags, splits, samples, quantiles and the readers and writers around them."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import curation, sampling
from winnow.operators.quantiles import lower_median, quantile
from winnow.sources import manifests


def test_flags_of_a_gzipped_listing_take_the_last_row(spark, tmp_path):
    path = tmp_path / "flags.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write('subject,study,Support Devices,note\n1,10,1.0,"a, b"\n1,10,-1.0,x\n2,20,,y\n3,30,0.0,z\n')
    flags = manifests.read_flags(spark, str(path), ["subject", "study"], "Support Devices")
    assert {r["study"]: r["flag"] for r in flags.collect()} == {"10": "-1.0", "20": "", "30": "0.0"}
    records = spark.createDataFrame([("1", "10", "a"), ("2", "20", "a"), ("4", "40", "b"), ("3", "30", None)], "subject string, study string, cls string")
    got = {(r["cls"], r["bucket"]): (r["n"], r["share"]) for r in curation.flag_report(records, flags, ["subject", "study"], "cls").collect()}
    assert got == {("a", "uncertain"): (1, 0.5), ("a", "unmentioned"): (1, 0.5), ("b", "unmatched"): (1, 1.0), (None, "no_device"): (1, 1.0)}


def test_labels_names_and_paths(spark):
    v = spark.createDataFrame([("1.0",), ("0.0",), ("-1.0",), (None,)], "v string")
    assert [r[0] for r in v.select(curation.label_of(F.col("v"), "sick", "well")).collect()] == ["sick", "well", None, None]
    assert [r[0] for r in v.select(curation.label_or_normal(F.col("v"), "sick", "well")).collect()] == ["sick", "well", "well", "well"]
    p = spark.createDataFrame([("a/b/1_20_x.y.png",), ("plain.jpg",)], "p string").select(curation.name_parts(F.col("p")).alias("n")).select("n.*")
    assert [tuple(r) for r in p.collect()] == [("1", "20", "x.y"), ("plain", None, None)]
    manifest = spark.createDataFrame([(1, "files/a.png"), (2, "files/b.png"), (3, None)], "id int, relpath string")
    listing = spark.createDataFrame([("r2/files/a.png",), ("r1/a.png",), ("r2/b.png",)], "path string")
    found = {r["id"]: r["found"] for r in curation.resolve_paths(manifest, listing, ["r1", "r2/"]).collect()}
    assert found == {1: "r1/a.png", 2: "r2/b.png", 3: None}


def test_drop_sets_and_leaks(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    drop = curation.drop_set(rows.where("k < 2"), rows.where("k between 1 and 3"), spark.createDataFrame([(None,)], "k long"), key="k")
    assert sorted(r["k"] for r in drop.collect()) == [0, 1, 2, 3]
    kept = curation.without(rows, drop, "k")
    assert kept.count() == 6
    curation.assert_disjoint(kept, drop, "k")
    with pytest.raises(ValueError):
        curation.assert_disjoint(rows, drop, "k")


def test_splits_and_balances(spark):
    rows = spark.range(101).withColumn("cls", F.when(F.col("id") < 11, "few").when(F.col("id") < 100, "many"))
    with pytest.raises(ValueError):
        sampling.split_halves(rows, "cls")
    rows = rows.where("cls is not null")
    parts = sampling.split_halves(rows, "cls")
    assert {(r["cls"], r["part"]): r["count"] for r in parts.groupBy("cls", "part").count().collect()} == {("few", "select"): 5, ("few", "eval"): 6, ("many", "select"): 44, ("many", "eval"): 45}
    assert {r["cls"]: r["count"] for r in sampling.balance(rows, "cls").groupBy("cls").count().collect()} == {"few": 11, "many": 11}
    once, again = (sorted(r["id"] for r in sampling.sample_n(rows.repartition(n), 7, 1).collect()) for n in (1, 5))
    assert once == again and len(set(once)) == 7
    draws = sampling.subset_draws(rows, 3, 20, 0)
    assert [r["count"] for r in draws.groupBy("subset").count().collect()] == [20] * 3
    assert draws.select("subset", "id").distinct().count() == 60
    assert sampling.sample_weighted(rows, 5, F.when(F.col("cls") == "few", 1.0).otherwise(0.0)).where("cls = 'many'").count() == 0


def test_quantiles_are_exact(spark):
    v = np.random.default_rng(1).normal(size=5000).round(2)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double").repartition(4)
    for q in (0.0, 0.01, 0.05, 0.5, 0.95, 1.0):
        assert quantile(df, "v", q) == pytest.approx(np.quantile(v, q))
    assert lower_median(df, "v") == np.sort(v)[2499]
    assert quantile(df.where("v > 100"), "v", 0.5) is None


def test_files_by_class_and_the_split_built_on_first_use(spark, tmp_path):
    for cls, n in (("a", 5), ("b", 4)):
        (tmp_path / "img" / cls).mkdir(parents=True)
        for i in range(n):
            (tmp_path / "img" / cls / f"{i}_1_{cls}.{'png' if i % 2 else 'jpg'}").write_bytes(b"x" * (i + 1))
        (tmp_path / "img" / cls / "note.txt").write_text("no image")
    files = manifests.list_files(spark, str(tmp_path / "img"))
    assert {r["cls"]: r["count"] for r in files.groupBy("cls").count().collect()} == {"a": 5, "b": 4}
    calls = []

    def build():
        calls.append(1)
        return files.select(F.col("path").alias("id"), "cls")

    at = str(tmp_path / "split")
    a, b = (manifests.load_split(spark, at, build, part) for part in ("select", "eval"))
    assert (a.count(), b.count(), len(calls)) == (4, 5, 1)
    curation.assert_disjoint(a, b, "id")


def test_feature_cache_is_filled_once(spark, tmp_path):
    paths = spark.createDataFrame([("p1",), ("p2",)], "path string")
    calls = []

    def extract(df):
        calls.append(1)
        return df.withColumn("x", F.array(F.lit(1.0)))

    for other in (paths, paths.orderBy(F.col("path").desc())):
        assert manifests.cached_features(spark, str(tmp_path), "v1", other, extract).count() == 2
    manifests.cached_features(spark, str(tmp_path), "v2", paths, extract)
    assert len(calls) == 2


def test_results_round_trip(spark, tmp_path):
    at, schema = str(tmp_path / "results"), "gen int, kid double"
    assert manifests.read_results(spark, at, schema).count() == 0
    manifests.write_results(spark.createDataFrame([(1, 0.5)], schema), at)
    assert [tuple(r) for r in manifests.read_results(spark, at, schema).collect()] == [(1, 0.5)]
    lines = str(tmp_path / "lines")
    manifests.write_lines(spark.createDataFrame([("a",), (None,), ("b",)], "p string"), "p", lines)
    assert sorted(r["value"] for r in spark.read.text(lines).collect()) == ["a", "b"]
    assert manifests.not_yet(spark.range(4), spark.range(2)).count() == 2
