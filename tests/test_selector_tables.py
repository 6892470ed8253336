"""What selectors move: rows that reach the driver, tables that are written, joins without a shuffle."""

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from winnow.operators import selectors
from winnow.sources import scratch


def pool(spark, n, d=6, seed=1, parts=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, d))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(parts)


def test_rows_at_the_driver_do_not_grow_with_the_pool(spark, monkeypatch):
    monkeypatch.setattr(selectors, "AHEAD", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    seen = []
    real = selectors._by_class
    monkeypatch.setattr(selectors, "_by_class", lambda t, names: (isinstance(t, pa.Table) and seen.append(t.num_rows)) or real(t, names))
    try:
        for n in (500, 3000):
            _, df = pool(spark, n)
            selectors.kcenter(df, 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(seen) == 64 and seen.count(64) >= 2  # candidates, of 5 and of 30 batches


def test_tables_of_a_pool_are_joined_without_a_shuffle(spark):
    _, df = pool(spark, 300)
    state = df.select(F.lit(0).alias("k"), "id", "x", F.lit(1.0).alias("q"), F.lit(1.0).alias("root"), F.lit(1.0).alias("gain"))
    p = selectors.Pool.of(state, selectors.Volume("rbf", 3, 1.0))
    p.take({0: []})
    p.take({0: []})
    plan = p.read(True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort [" not in plan and plan.count("ShuffledHashJoin") == 2
    assert p.read(True).count() == 300
    p.drop()


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))


def test_written_bytes_grow_with_picks_not_with_their_square(spark, monkeypatch):
    """Vectors are written twice in all (dealt, and without the numbers), and a pick adds one number a row."""
    monkeypatch.setattr(selectors, "STEPS", 8)
    total, vectors = [0], [0]
    real = scratch.Dealt._write

    def write(self, df, mode):
        before = _bytes(self.path)
        real(self, df, mode)
        total[0] += _bytes(self.path) - before
        vectors[0] += "x" in df.columns

    monkeypatch.setattr(scratch.Dealt, "_write", write)
    _, df = pool(spark, 1500, d=20)
    sizes = []
    for n in (24, 48, 96):
        total[0] = vectors[0] = 0
        selectors.dpp(df, n, sigma=6.0)
        sizes.append(total[0])
        assert vectors[0] == 2
    assert sizes[2] - sizes[1] < 2.5 * (sizes[1] - sizes[0]), sizes


def test_nothing_is_left_in_the_scratch_folder(spark):
    _, df = pool(spark, 60)
    home = scratch.scratch_dir(spark).removeprefix("file:")
    before = {f for f in os.listdir(home)} if os.path.isdir(home) else set()
    selectors.dpp(df, 5, sigma=2.0)
    selectors.kcenter(df, 5)
    assert {f for f in os.listdir(home)} == before
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("winnow_")]


def test_guesses_that_fail_leave_picks_exact(spark, monkeypatch):
    """Few candidates and few steps, two classes of unequal size, against a plain loop."""
    monkeypatch.setattr(selectors, "AHEAD", 4)
    monkeypatch.setattr(selectors, "STEPS", 4)
    x, df = pool(spark, 140, d=4, seed=7)
    df = df.withColumn("cls", (F.col("id") % 5 == 0).cast("int"))
    got = {}
    for r in selectors.dpp(df, 12, "cls", sigma=1.5)[0].orderBy("pick_no").collect():
        got.setdefault(r["cls"], []).append(r["id"])
    for c in (0, 1):
        ids = np.array([i for i in range(140) if (i % 5 == 0) == bool(c)])
        k = np.exp(-((x[ids][:, None] - x[ids][None]) ** 2).sum(-1) / (2 * 1.5**2))
        gain, columns, want = np.ones(len(ids)), np.zeros((len(ids), 0)), []
        for _ in range(12):
            free = [i for i in range(len(ids)) if ids[i] not in want]
            best = max(free, key=lambda i: (gain[i], -ids[i]))
            e = (k[:, best] - columns @ columns[best]) / np.sqrt(gain[best])
            gain, columns = gain - e * e, np.column_stack([columns, e])
            want.append(int(ids[best]))
        assert got[c] == want
