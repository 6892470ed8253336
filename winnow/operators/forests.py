"""Forests for out-of-fold probabilities over many vectors: a level of all trees of all folds in one job.

Rules are those of Spark's own forest: features in ``BINS`` bins, a Poisson bag and at each node a draw of features for
each tree, splits by the Gini impurity until a node is pure, nothing is gained or ``depth`` is reached. Spark's keeps a task per
part of the rows busy for each tree, node and row by objects; here vectors are binned once and stand in blocks of bytes. A task takes a block and
some trees: it draws a tree's bag anew from a seed, walks the rows down to the level's nodes and counts them, and only the counts are shuffled, by tree.
They are added up there and give the splits. The driver has the trees, whose number and depth are fixed; blocks have fixed
bytes, so what a task or a group holds doesn't grow with the rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.order import seeded
from winnow.functions.vectors import matrix
from winnow.sources.scratch import written

BINS = 32  # of a feature
SAMPLE = 12_500  # rows that the bins' edges are taken from
BLOCK_BYTES = 8 << 20  # of binned vectors that stand together
TASKS = 4  # blocks a core, at least; groups of trees have blocks of their own where rows have too few
ROWS = 1 << 15  # of a block at a time
SENT_BYTES = 4 << 20  # of counts that leave a task at once
GROUP_BYTES = 32 << 20  # of counts of one tree's nodes that are added up together
POISSON = np.repeat(np.arange(9, dtype=np.uint8), [24109, 24109, 12055, 4018, 1005, 201, 33, 5, 1])  # of mean 1, by 16 random bits


@dataclass
class Shape:
    folds: int
    trees: int
    depth: int
    seed: int
    d: int
    groups: int = 1

    @property
    def drawn(self) -> int:
        """Features that a node chooses from."""
        return int(np.ceil(np.sqrt(self.d))) if self.trees > 1 else self.d

    def rng(self, *place: int) -> np.random.Generator:
        return np.random.default_rng([self.seed & 0xFFFFFFFF, *place])


def edges(values: np.ndarray) -> np.ndarray:
    """At most ``BINS`` - 1 values that halve the way between neighbours, all of them or those nearest to equal shares. A bin is what lies over as many edges."""
    distinct, counts = np.unique(values[~np.isnan(values)], return_counts=True)
    between = (distinct[:-1] + distinct[1:]) / 2
    if len(between) < BINS:
        return between
    under = np.cumsum(counts)[:-1]
    want = np.arange(1, BINS) * counts.sum() / BINS
    at = np.clip(np.searchsorted(under, want), 1, len(under) - 1)
    return between[np.unique(at - (want - under[at - 1] < under[at] - want))]


def _edges(rows: DataFrame, folds: int, seed: int) -> list[list[np.ndarray]]:
    """Of each fold's training rows and each feature."""
    t = rows.orderBy(seeded(f"{seed}bins", "label", "id"), "label", "id").limit(SAMPLE).select("fold", "x").toArrow()
    fold, x = np.asarray(t["fold"]), matrix(t["x"])
    return [[edges(column) for column in x[fold != k].T] for k in range(folds)]


def _blocks(rows: DataFrame, n: int, shape: Shape, cuts: list[list[np.ndarray]]) -> tuple[DataFrame, int]:
    """(fold, group, train, test, id, label): the bins of each fold's training rows, twice their number and the label, and of its own rows, with whose they are.

    A block is written once for each group of trees. Also returns the number of blocks of a fold.
    """
    parts = max(1, -(-n * shape.d // BLOCK_BYTES))
    shape.groups = int(min(shape.trees, max(1, -(-TASKS * rows.sparkSession.sparkContext.defaultParallelism // (parts * shape.folds)))))
    kind = rows.schema["id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(cuts)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, folds, binned = [], [], [], [[] for _ in range(shape.folds)]
        for b in batches:
            x = matrix(b["x"])
            ids.append(b["id"])
            labels.append(np.asarray(b["label"]))
            folds.append(np.asarray(b["fold"]))
            for k, of in enumerate(sent.value if len(x) else []):
                out = np.empty(x.shape, np.uint8)
                for j, edge in enumerate(of):
                    out[:, j] = np.searchsorted(edge, x[:, j])
                binned[k].append(2 * out)
        if not any(len(one) for one in ids):
            return
        ids, label, fold = pa.concat_arrays(ids), np.concatenate(labels), np.concatenate(folds)
        for k in range(shape.folds):
            x, own = np.concatenate(binned[k]), fold == k
            binned[k] = None
            train, test = x[~own] + label[~own].astype(np.uint8)[:, None], x[own]
            whose = [pa.ListArray.from_arrays(pa.array([0, int(own.sum())], pa.int32()), v) for v in (ids.filter(pa.array(own)), pa.array(label[own]))]
            for g in range(shape.groups):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([g], pa.int32()), pa.array([train.tobytes()], pa.binary()), pa.array([test.tobytes()], pa.binary()), *whose], ["fold", "group", "train", "test", "id", "label"])

    dealt = rows.repartition(parts, "id", "label").sortWithinPartitions("id", "label")
    return written(dealt.mapInArrow(block, f"fold int, group int, train binary, test binary, id array<{kind}>, label array<double>"), 1), parts


@contextmanager
def _a_task_a_file(spark: SparkSession, files: int) -> Iterator[None]:
    """Files, which hold a block each, are not put together for a task: cores that are done take another block."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, files)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def drawn_features(shape: Shape, fold: int, tree: int, level: int, nodes: int) -> np.ndarray:
    """Which features each of a level's nodes chooses from."""
    out, every, rng = np.tile(np.arange(shape.d), (nodes, 1)), np.arange(nodes), shape.rng(0, fold, tree, level)
    for j in range(shape.drawn):
        other = rng.integers(j, shape.d, nodes)
        mine = out[:, j].copy()
        out[:, j] = out[every, other]
        out[every, other] = mine
    return out[:, : shape.drawn]


def bag(shape: Shape, fold: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often a tree takes each of a block's ``n`` rows."""
    return POISSON[shape.rng(1, fold, tree, block).integers(0, len(POISSON), n, dtype=np.uint16)]


class Walk:
    """Room for ``ROWS`` rows at a time, used again for every tree, as fresh arrays of that size cost more than what is computed."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        self.node, self.at = np.empty(ROWS, np.int64), np.empty(ROWS, np.int64)
        self.bin, self.edge, self.right = np.empty(ROWS, np.uint8), np.empty(ROWS, np.uint8), np.empty(ROWS, bool)

    def bins(self, feature: np.ndarray, node: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Of rows (where they begin), that of the feature that their node has."""
        at, out = self.at[: len(base)], self.bin[: len(base)]
        feature.take(node, out=at, mode="clip")  # without it, take makes an array more
        at += base
        return self.flat.take(at, out=out, mode="clip")

    def down(self, base: np.ndarray, feature: np.ndarray, edge: np.ndarray, steps: int) -> np.ndarray:
        """The node of the level ``steps`` that rows come to, from 0. A node without a split sends them on all the same."""
        node, right = self.node[: len(base)], self.right[: len(base)]
        node[:] = 0
        for _ in range(steps):
            bins = self.bins(feature, node, base)
            np.greater(bins, edge.take(node, out=self.edge[: len(base)], mode="clip"), out=right)
            node *= 2
            node += 1
            node += right
        node -= (1 << steps) - 1
        return node


@dataclass
class Trees:
    """Nodes stand level by level, the children of i at 2 i + 1 and 2 i + 2."""

    feature: np.ndarray
    edge: np.ndarray  #: twice the last bin that goes left, plus 1
    open: np.ndarray  #: nodes of the last level that may be split

    @staticmethod
    def of(shape: Shape) -> Trees:
        nodes = (shape.folds, shape.trees, (1 << shape.depth) - 1)
        return Trees(np.zeros(nodes, np.int16), np.full(nodes, 255, np.uint8), np.ones((shape.folds, shape.trees, 1), bool))


def counts(rows: Walk, block: int, shape: Shape, trees: Trees, fold: int, tree: int, level: int) -> np.ndarray:
    """(drawn feature, open node, bin, label) of a block's training rows, each as often as the tree takes it."""
    is_open = trees.open[fold, tree]
    cell, nodes = 2 * BINS * np.where(is_open, np.cumsum(is_open) - 1, -1), int(is_open.sum())
    drawn = np.ascontiguousarray(drawn_features(shape, fold, tree, level, nodes).T)
    feature, edge = trees.feature[fold, tree].astype(np.int64), trees.edge[fold, tree]
    drawn_at = np.zeros((len(drawn), len(is_open)), np.int64)
    drawn_at[:, is_open] = drawn
    times = bag(shape, fold, tree, block, len(rows.flat) // shape.d)
    taken = np.flatnonzero(times)
    out = np.zeros((len(drawn), nodes * 2 * BINS), np.int32)
    for i in range(0, len(taken), ROWS):
        some = taken[i : i + ROWS]
        base, n = some * shape.d, times[some].astype(np.int32)
        node = rows.down(base, feature, edge, level)
        first = cell.take(node)
        if first.min(initial=0) < 0:
            on = first >= 0
            node, first, base, n = node[on], first[on], base[on], n[on]
        for mine, total in zip(drawn_at, out):
            np.add.at(total, first + rows.bins(mine, node, base), n)
    return out.reshape(len(drawn), nodes, BINS, 2)


def best_splits(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the counts of nodes: place of the feature (-1: no split gains), last bin that goes left, and the share of label 1 on both sides.

    Of two labels, the gain is the square of what label 1 on the left has over its share of the whole, over the product of both sides.
    """
    ones = np.cumsum(n[..., 1], axis=2, dtype=np.float64).transpose(1, 0, 2).copy()
    both = np.cumsum(n[..., 0] + n[..., 1], axis=2, dtype=np.float64).transpose(1, 0, 2).copy()
    n1, whole = ones[:, :1, -1:], both[:, :1, -1:]
    p = n1 / np.maximum(whole, 1)
    ones, both = ones[:, :, :-1].reshape(len(p), -1), both[:, :, :-1].reshape(len(p), -1)
    n1, whole, p = n1[:, 0], whole[:, 0], p[:, 0]
    sides = both * (whole - both)
    gain = np.square(ones - both * p)
    gain /= np.maximum(sides, 1)  # 0 where a side is empty
    at = gain.argmax(1)[:, None]
    left, of_left = np.take_along_axis(both, at, 1), np.take_along_axis(ones, at, 1)
    split = (np.take_along_axis(gain, at, 1) > 1e-12) & (left > 0) & (left < whole)
    shares = [np.where(split, a / np.maximum(b, 1), p)[:, 0] for a, b in ((of_left, left), (n1 - of_left, whole - left))]
    at, split = at[:, 0], split[:, 0]
    return np.where(split, at // (BINS - 1), -1), at % (BINS - 1), *shares


def _level(blocks: DataFrame, parts: int, shape: Shape, trees: Trees, level: int) -> pa.Table:
    """(fold, tree, first, feature, edge, left, right): the splits of a level's open nodes from the ``first`` on."""
    sent = blocks.sparkSession.sparkContext.broadcast(trees)
    node = shape.drawn * 2 * BINS
    together = max(1, GROUP_BYTES // (parts * node * 4))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for b in batches:
            for fold, group, train in zip(b["fold"].to_pylist(), b["group"].to_pylist(), b["train"]):
                flat = np.frombuffer(train.as_buffer(), np.uint8)
                rows, block = Walk(flat), zlib.crc32(flat)
                for tree in range(group, shape.trees, shape.groups):
                    if not sent.value.open[fold, tree].any():
                        continue
                    n = counts(rows, block, shape, sent.value, fold, tree, level)
                    n = n.astype(np.min_scalar_type(n.max(initial=0)))
                    for first in range(0, n.shape[1], together):
                        out.append((fold, tree, first, n[:, first : first + together].tobytes()))
                        size += len(out[-1][-1])
                    if size >= SENT_BYTES:
                        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, row)) for row in out], kind)
                        out, size = [], 0
        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, row)) for row in out], kind)

    kind = pa.schema([("fold", pa.int32()), ("tree", pa.int32()), ("first", pa.int32()), ("n", pa.binary())])

    def split(t: pa.Table) -> pa.Table:
        fold, tree, first = (t[c][0].as_py() for c in ("fold", "tree", "first"))
        nodes = int(sent.value.open[fold, tree].sum())
        here = min(together, nodes - first)
        n = np.zeros(here * node, np.int64)
        for some in t["n"]:
            some = some.as_buffer()
            n += np.frombuffer(some, f"u{some.size // len(n)}")
        place, edge, left, right = best_splits(n.reshape(shape.drawn, here, BINS, 2))
        features = drawn_features(shape, fold, tree, level, nodes)[first : first + here]
        feature = np.where(place < 0, -1, features[np.arange(here), np.maximum(place, 0)])
        columns = [feature.astype(np.int16), (2 * edge + 1).astype(np.uint8), left, right]
        return pa.table([pa.array([v], kind.field(i).type) for i, v in enumerate((fold, tree, first))] + [pa.array([c.tobytes()], pa.binary()) for c in columns], ["fold", "tree", "first", "feature", "edge", "left", "right"])

    bytes_ = int(trees.open.sum()) * node * 2 * parts
    tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-bytes_ // GROUP_BYTES))
    found = blocks.select("fold", "group", "train").mapInArrow(count, "fold int, tree int, first int, n binary").repartition(tasks, "fold", "tree", "first")
    out = found.groupBy("fold", "tree", "first").applyInArrow(split, "fold int, tree int, first int, feature binary, edge binary, left binary, right binary").toArrow()
    sent.destroy()
    return out


def grow(blocks: DataFrame, parts: int, shape: Shape) -> tuple[Trees, np.ndarray]:
    """All trees, and the share of label 1 in the nodes under their last level; a node that is not split has its share in all that are under it."""
    trees = Trees.of(shape)
    share = np.zeros((shape.folds, shape.trees, 1))
    for level in range(shape.depth):
        below = np.repeat(share, 2, axis=2)
        is_open = np.zeros(below.shape, bool)
        if trees.open.any():
            for r in _level(blocks, parts, shape, trees, level).to_pylist():
                k, t = r["fold"], r["tree"]
                feature, edge, left, right = (np.frombuffer(r[c], kind) for c, kind in (("feature", np.int16), ("edge", np.uint8), ("left", np.float64), ("right", np.float64)))
                nodes = np.flatnonzero(trees.open[k, t])[r["first"] : r["first"] + len(feature)]
                below[k, t, 2 * nodes], below[k, t, 2 * nodes + 1] = left, right
                nodes, split = nodes[feature >= 0], feature >= 0
                at = nodes + (1 << level) - 1
                trees.feature[k, t, at], trees.edge[k, t, at] = feature[split], edge[split]
                for side, p in ((2 * nodes, left[split]), (2 * nodes + 1, right[split])):
                    is_open[k, t, side] = (p > 0) & (p < 1)
        trees.open, share = is_open, below
    return trees, share


def out_of_fold(rows: DataFrame, n: int, folds: int, trees: int, depth: int, seed: int) -> DataFrame:
    """(id, label, p) of (id, x, label 0/1, fold): the probability of label 1 under a forest that has not seen the row."""
    cuts = _edges(rows, folds, seed)
    shape = Shape(folds, trees, depth, seed, len(cuts[0]))
    blocks, parts = _blocks(rows, n, shape, cuts)
    with _a_task_a_file(rows.sparkSession, parts * folds * shape.groups):
        return _scored(blocks, *grow(blocks, parts, shape), shape, rows.schema["id"].dataType.simpleString())


def _scored(blocks: DataFrame, grown: Trees, share: np.ndarray, shape: Shape, kind: str) -> DataFrame:
    """(id, label, p) of the rows that a fold keeps out."""
    sent = blocks.sparkSession.sparkContext.broadcast((grown.feature, grown.edge, share))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, edge, share = sent.value
        for b in batches:
            for i, (fold, group) in enumerate(zip(b["fold"].to_pylist(), b["group"].to_pylist())):
                flat = np.frombuffer(b["test"][i].as_buffer(), np.uint8)
                rows, p = Walk(flat), np.zeros(len(flat) // shape.d)
                for tree in range(group, shape.trees, shape.groups):
                    of, at = feature[fold, tree].astype(np.int64), edge[fold, tree]
                    for first in range(0, len(p), ROWS):
                        base = np.arange(first, min(first + ROWS, len(p))) * shape.d
                        p[first : first + ROWS] += share[fold, tree].take(rows.down(base, of, at, shape.depth))
                yield pa.RecordBatch.from_arrays([b["id"][i].values, b["label"][i].values, pa.array(p)], ["id", "label", "p"])

    scored = blocks.select("fold", "group", "test", "id", "label").mapInArrow(score, f"id {kind}, label double, p double")
    return written(scored.groupBy("id", "label").agg((F.sum("p") / shape.trees).alias("p")))
