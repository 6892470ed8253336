"""A forest grown a level of all trees at a time is the forest of all rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import forests, models


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")


def gini(y, w):
    p = (w * y).sum() / w.sum()
    return 2 * p * (1 - p) * w.sum()


def grown(bins, y, w, shape, fold, tree, trees):
    """Node by node: {node: (feature, last bin to the left)} and the shares of label 1. Of splits that gain the same, that of ``trees``; it must gain the most by plain loops."""
    nodes, rows_of, still = {}, {0: np.arange(len(y))}, [0]
    for level in range(shape.depth):
        drawn, after = forests.drawn_features(shape, fold, tree, level, len(still)), []
        for node, features in zip(still, drawn):
            at, gains = rows_of[node], {}
            for f in features:
                for edge in range(forests.BINS - 1):
                    left = bins[at, f] <= edge
                    if w[at][left].sum() and w[at][~left].sum():
                        gains[f, edge] = gini(y[at], w[at]) - gini(y[at][left], w[at][left]) - gini(y[at][~left], w[at][~left])
            if max(gains.values(), default=0) <= 1e-9:
                assert trees.edge[fold, tree, node] == 255
                continue
            nodes[node] = f, edge = trees.feature[fold, tree, node], trees.edge[fold, tree, node] // 2
            assert gains[f, edge] > max(gains.values()) - 1e-9
            for child, side in ((2 * node + 1, bins[at, f] <= edge), (2 * node + 2, bins[at, f] > edge)):
                rows_of[child] = at[side]
                if 0 < (w * y)[at[side]].sum() < w[at[side]].sum():
                    after.append(child)
        still = after
    return nodes, {node: (w * y)[at].sum() / w[at].sum() for node, at in rows_of.items()}


@pytest.mark.parametrize("group_bytes", [3000, 1 << 20])
def test_trees_are_those_of_loops_over_all_rows(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(forests, "BLOCK_BYTES", 600)
    monkeypatch.setattr(forests, "ROWS", 32)
    monkeypatch.setattr(forests, "GROUP_BYTES", group_bytes)
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, (130, 5)).round(1), rng.normal(0.7, 1, (120, 5)).round(1)
    rows, n = models._folds(frame(spark, a), frame(spark, b), 2, 3)
    cuts = forests._edges(rows, 2, 3)
    shape = forests.Shape(2, 3, 3, 3, 5)
    table, parts = forests._blocks(rows, n, shape, cuts)
    blocks = table.collect()
    assert parts == 3 and len(blocks) == 2 * 3 * shape.groups and n == 250
    trees, share = forests.grow(table, parts, shape)
    want, tree_of = {}, {}
    for k in range(2):
        mine = [r for r in blocks if r["fold"] == k and r["group"] == 0]
        packed = [np.frombuffer(r["train"], np.uint8).reshape(-1, 5) for r in mine]
        x = np.concatenate(packed)
        for t in range(3):
            w = np.concatenate([forests.bag(shape, k, t, zlib.crc32(p), len(p)) for p in packed]).astype(float)
            tree_of[k, t] = grown(x >> 1, x[:, 0] & 1, w, shape, k, t, trees)
        for r in mine:
            for i, label, test in zip(r["id"], r["label"], np.frombuffer(r["test"], np.uint8).reshape(-1, 5) >> 1):
                p = 0.0
                for t in range(3):
                    nodes, shares = tree_of[k, t]
                    node = 0
                    while node in nodes:
                        node = 2 * node + (1 if test[nodes[node][0]] <= nodes[node][1] else 2)
                    p += shares[node] / 3
                want[i, label] = p
    got = {(r["id"], r["label"]): r["p"] for r in forests.out_of_fold(rows, n, 2, 3, 3, 3).collect()}
    assert got.keys() == want.keys() and len(got) == 250
    assert all(abs(got[key] - want[key]) < 1e-9 for key in got)


def test_a_block_has_each_row_once_in_training_or_apart(spark, monkeypatch):
    monkeypatch.setattr(forests, "BLOCK_BYTES", 300)
    x = np.arange(90.0).reshape(-1, 1).repeat(3, 1)
    rows, n = models._folds(frame(spark, x[:50]), frame(spark, x[50:]), 3, 0)
    shape = forests.Shape(3, 2, 2, 0, 3)
    table, _ = forests._blocks(rows, n, shape, forests._edges(rows, 3, 0))
    fold = {(r["id"], r["label"]): r["fold"] for r in rows.collect()}
    for k in range(3):
        mine = table.where((F.col("fold") == k) & (F.col("group") == 0)).collect()
        own = [key for r in mine for key in zip(r["id"], r["label"])]
        assert sorted(own) == sorted(key for key, f in fold.items() if f == k)
        assert sum(len(r["train"]) for r in mine) == 3 * (90 - len(own)) and sum(len(r["test"]) for r in mine) == 3 * len(own)
    assert all(r["train"] is not None for r in table.collect())


def test_many_rows_take_a_job_a_level_and_no_fit_a_group(spark, monkeypatch):
    """compare_filters, two_sample_forest: 60 and 20 fits of Spark's forest, each of ten jobs and more, took most of their time."""
    levels, level = [], forests._level

    def counted(*args):
        levels.append(args[-1])
        return level(*args)

    monkeypatch.setattr(forests, "_level", counted)
    monkeypatch.setattr(models, "FEW", 100)
    monkeypatch.delattr(models, "RandomForestClassifier")
    rng = np.random.default_rng(1)
    real, other, same = (frame(spark, rng.normal(mean, 1, (150, 4)), at) for mean, at in ((0, 0), (2, 0), (0, 0)))
    assert models.c2st(real, other, trees=20, depth=4) > 0.9
    assert levels == [0, 1, 2, 3]
    assert 0.35 < models.c2st(real, same, trees=20, depth=4) < 0.65
    got = models.forest_rank(real, other, trees=20, depth=4).collect()
    assert sorted(r["id"] for r in got) == list(range(150)) and np.mean([r["score"] for r in got]) > 0.8 and all(0 <= r["score"] <= 1 for r in got)
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_edges_halve_the_way_or_share_equally():
    assert forests.edges(np.array([3.0, 1, 1, 2, np.nan])).tolist() == [1.5, 2.5]
    assert forests.edges(np.array([2.0, 2])).tolist() == []
    cuts = forests.edges(np.arange(3200.0))
    assert len(cuts) == 31 and np.abs(np.diff(np.concatenate([[-0.5], cuts, [3199.5]])) - 100).max() <= 1
    heavy = forests.edges(np.concatenate([np.zeros(1000), np.arange(1, 101)]))
    assert 0 < len(heavy) < 32 and np.all(np.diff(heavy) > 0)


def test_best_splits_are_those_of_the_impurity():
    rng = np.random.default_rng(2)
    n = rng.integers(0, 3, (4, 6, forests.BINS, 2))
    n[1:] = 0
    for f in range(1, 4):  # the same rows in other bins
        n[f] = n[0][:, rng.permutation(forests.BINS)]
    n[:, 5, :, 1] = 0  # a pure node
    place, edge, left, right = forests.best_splits(n)
    impurity = lambda c: 2 * c[..., 0] * c[..., 1] / max(c.sum(), 1)
    for node in range(6):
        gains = {(f, e): impurity(n[f, node].sum(0)) - impurity(n[f, node, : e + 1].sum(0)) - impurity(n[f, node, e + 1 :].sum(0)) for f in range(4) for e in range(forests.BINS - 1)}
        if node == 5:
            assert place[node] == -1 and left[node] == right[node] == 0
            continue
        assert abs(gains[place[node], edge[node]] - max(gains.values())) < 1e-9
        sides = n[place[node], node, : edge[node] + 1].sum(0), n[place[node], node, edge[node] + 1 :].sum(0)
        assert np.allclose([left[node], right[node]], [s[1] / s.sum() for s in sides])
