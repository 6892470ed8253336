"""Fitted models over vectors: balanced clusters, two-sample tests, rank by a forest, linear probe, AUROC."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.order import seeded
from winnow.operators import forests
from winnow.operators.sampling import n_per_class, sample_n
from winnow.sources.scratch import written

TREES = 50  # of a forest, fitted as one
FITS = 8  # at a time, at most
FEW = 256  # rows, at most, that Spark's own forest is fitted to; fits at once take much of the driver's memory


def _ml(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("x"))


def kmeans_balanced(pool: DataFrame, n: int, clusters: int = 200, seed: int = 0) -> DataFrame:
    """``n`` rows (id, cluster): n // clusters of each cluster, filled up from the rest in the seeded order."""
    model = KMeans(k=clusters, seed=seed, maxIter=20).fit(_ml(pool))
    rows = written(model.transform(_ml(pool)).select("id", F.col("prediction").alias("cluster")))
    even = written(n_per_class(rows, "cluster", n // clusters, seed))
    rest = sample_n(rows.join(even.select("id"), "id", "left_anti"), max(0, n - even.count()), seed + 1)
    return even.unionByName(rest).limit(n)


def _folds(reference: DataFrame, candidates: DataFrame, folds: int, seed: int) -> tuple[DataFrame, int]:
    """Both sets with their folds, and the number of rows."""
    both = reference.select("id", "x", F.lit(0.0).alias("label")).unionByName(candidates.select("id", "x", F.lit(1.0).alias("label")))
    fold = F.pmod(F.conv(F.substring(seeded(seed, "label", "id"), 1, 8), 16, 10).cast("long"), F.lit(folds))
    rows = written(both.withColumn("fold", fold))
    return rows, rows.count()


def _out_of_fold(rows: DataFrame, n: int, folds: int, trees: int, depth: int, seed: int) -> DataFrame:
    """``rows`` with ``p``, the probability of being a candidate under a forest that has not seen the row.

    Up to ``FEW`` rows, Spark's forest is fitted, ``FITS`` groups of ``TREES`` trees at a time. Its time grows fast with the rows, so more go to :mod:`forests`.
    A forest's probability is the mean over its trees, so groups add up.
    """
    if n > FEW:
        return forests.out_of_fold(rows, n, folds, trees, depth, seed)
    rows = written(rows.repartition(1, "id", "label").sortWithinPartitions("id", "label"))
    groups = [(k, at, min(TREES, trees - at)) for k in range(folds) for at in range(0, trees, TREES)]

    def fit(group: tuple[int, int, int]) -> DataFrame:
        k, at, n = group
        model = RandomForestClassifier(numTrees=n, maxDepth=depth, seed=seed + at).fit(_ml(rows.where(F.col("fold") != k).coalesce(1)))
        scored = model.transform(_ml(rows.where(F.col("fold") == k)))
        return written(scored.select("id", "label", (vector_to_array("probability")[1] * n).alias("p")))

    with ThreadPool(max(1, min(FITS, rows.sparkSession.sparkContext.defaultParallelism, len(groups)))) as pool:
        scored = pool.map(inheritable_thread_target(rows.sparkSession)(fit), groups, 1)
    return reduce(lambda a, b: a.unionByName(b), scored).groupBy("id", "label").agg((F.sum("p") / trees).alias("p"))


def c2st(reference: DataFrame, candidates: DataFrame, folds: int = 5, trees: int = 200, depth: int = 10, seed: int = 0) -> float:
    """Accuracy of telling candidates from the reference; 0.5 is indistinguishable. NaN under 10 rows."""
    if min(reference.count(), candidates.count()) < 10:
        return float("nan")
    scored = _out_of_fold(*_folds(reference, candidates, folds, seed), folds, trees, depth, seed)
    return scored.agg(F.avg(((F.col("p") >= 0.5).cast("double") == F.col("label")).cast("double")).alias("a")).first()["a"]


def forest_rank(reference: DataFrame, candidates: DataFrame, folds: int = 5, trees: int = 200, depth: int = 10, seed: int = 0) -> DataFrame:
    """(id, score): each candidate's out-of-fold probability of being one; lower is more real."""
    scored = _out_of_fold(*_folds(reference, candidates, folds, seed), folds, trees, depth, seed)
    return scored.where("label = 1").select("id", F.col("p").alias("score"))


def linear_probe(train: DataFrame, test: DataFrame, c: float = 1.0, steps: int = 200) -> DataFrame:
    """(id, y, p) of ``test`` (id, x, y 0/1) under a ridge logistic regression of ``train``."""
    n = train.count()
    model = LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=steps, labelCol="y").fit(_ml(train).withColumn("y", F.col("y").cast("double")))
    return model.transform(_ml(test).withColumn("y", F.col("y").cast("double"))).select("id", "y", vector_to_array("probability")[1].alias("p"))


def class_weights(df: DataFrame, cls: str) -> DataFrame:
    """(class, n, weight): n over twice the class's rows."""
    n = df.groupBy(cls).agg(F.count("*").alias("n"))
    return n.withColumn("weight", F.sum("n").over(Window.partitionBy()) / (2.0 * F.greatest(F.col("n"), F.lit(1))))


def binary_report(df: DataFrame, score: str, label: str, threshold: float = 0.5, inclusive: bool = True) -> DataFrame:
    """One row: AUROC (null with one class), recalls, accuracy and confusion counts at a threshold.

    AUROC counts, for each distinct score, the pairs that it settles; equal scores count half.
    """
    y = F.col(label).cast("int")
    by = df.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n"))
    # running sums in two steps, so that no task has all scores
    parts = written(by.repartitionByRange("s").sortWithinPartitions("s").withColumn("pos", F.monotonically_increasing_id()).withColumn("part", F.shiftright("pos", 33)))
    sums = parts.groupBy("part").agg(F.sum("n").alias("n"))
    ahead = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = parts.withColumn("inner", inner).join(F.broadcast(ahead), "part").agg(F.sum(F.col("p") * (F.col("ahead") + F.col("inner") + F.col("n") / 2.0)).alias("won"))
    hit = (F.col("s") >= threshold) if inclusive else (F.col("s") > threshold)
    counts = by.agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fp"))
    zero = F.lit(0)
    safe = lambda a, b: F.when(b > 0, a / b)
    return counts.join(won, F.lit(True), "left").select(
        safe(F.col("won"), F.col("p") * F.col("n")).alias("auroc"), safe(F.col("tp"), F.col("p")).alias("recall_pos"), safe(F.col("n") - F.col("fp"), F.col("n")).alias("recall_neg"),
        safe(F.col("tp") + F.col("n") - F.col("fp"), F.col("p") + F.col("n")).alias("accuracy"), F.coalesce("tp", zero).alias("tp"), F.coalesce("fp", zero).alias("fp"), F.coalesce(F.col("p") - F.col("tp"), zero).alias("fn"), F.coalesce(F.col("n") - F.col("fp"), zero).alias("tn"),
    )
