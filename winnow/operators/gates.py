"""Gates: boolean columns that keep or drop candidates. Thresholds are taken over the full pool."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.operators import pairs, setmetrics
from winnow.operators.quantiles import quantile, quantiles
from winnow.operators.sampling import numbered
from winnow.sources.scratch import written


def memorisation_gate(pool: DataFrame, reference: DataFrame, pct: float = 1) -> tuple[DataFrame, dict]:
    """(id, d, keep): drop what is nearer to the reference than its ``pct``-th percentile of spacing."""
    tau = quantile(written(setmetrics.spacing(reference)), "d", pct / 100)
    out = written(setmetrics.to_reference(pool, reference)).withColumn("keep", F.col("d") >= tau)
    r = out.agg(F.count("*").alias("n"), F.count_if(~F.col("keep")).alias("x")).first()
    return out, {"tau": round(tau, 4), "pct": pct, "n_in": r["n"], "n_dropped": r["x"], "drop_frac": round(r["x"] / max(1, r["n"]), 4)}


def realism_gate(pool: DataFrame, reference: DataFrame, drop: float = 0.05, sigma: float | None = None) -> DataFrame:
    """(id, affinity, keep): drop the lowest share by mean rbf kernel to the reference."""
    sigma = sigma or setmetrics.median_sigma(reference)
    a = written(pairs.kernel_means(pool, reference, "rbf", sigma=sigma).withColumnRenamed("mean", "affinity"))
    return a.withColumn("keep", F.col("affinity") > quantile(a, "affinity", drop))


def score_gate(scores: DataFrame, score: str, drop: float = 0.05) -> DataFrame:
    """``scores`` with ``keep``: under the (1 - drop) quantile, so the highest go (scores of line content)."""
    return scores.withColumn("keep", F.col(score) < quantile(scores, score, 1 - drop))


def max_score_gate(scores: DataFrame, score: str, most: float) -> DataFrame:
    return scores.withColumn("keep", F.col(score) <= most)


def validity(std: Column, rail_share: Column, realism: Column | None = None, realism_floor: float | None = None, std_min: float = 6.0, rail_max: float = 0.35) -> Column:
    """Enough contrast, few pixels at the rails and, if given, realism over the floor."""
    ok = (std >= std_min) & (rail_share <= rail_max)
    return ok if realism is None else ok & (realism > realism_floor)


def anatomy(heart: Column, left: Column, right: Column, heart_min: float = 0.005, lung_min: float = 0.02, ratio_max: float = 6.0) -> Column:
    """Areas of heart and lungs in range; unknown areas (a failed segmenter) are kept."""
    small, large = F.least(left, right), F.greatest(left, right)
    return F.coalesce((heart >= heart_min) & (small >= lung_min) & (large / F.greatest(small, F.lit(1e-9)) <= ratio_max), F.lit(True))


def chunk_quantile_gate(scores: DataFrame, score: str, order: str, drop: float = 0.03, chunk: int = 2000) -> DataFrame:
    """``scores`` with ``keep``: over the quantile of the row's own chunk of ``chunk`` rows in the order of a column, which has no repeats."""
    w = Window.partitionBy(F.floor(F.col("_at") / chunk))
    return numbered(scores, order, "_at").withColumn("keep", F.col(score) > F.percentile(score, F.lit(drop)).over(w)).drop("_at")


def compose(pool: DataFrame, gates: dict[str, DataFrame]) -> tuple[DataFrame, dict]:
    """(pool columns, a column a gate, keep) and counts dropped by each gate; an id that a gate does not know is kept by it."""
    out = pool
    for name, g in gates.items():
        out = out.join(g.select("id", F.col("keep").alias(name)), "id", "left").withColumn(name, F.coalesce(name, F.lit(True)))
    out = out.withColumn("keep", reduce(lambda a, b: a & b, (F.col(n) for n in gates), F.lit(True)))
    r = out.agg(F.count("*").alias("n_in"), F.count_if("keep").alias("n_kept"), *(F.count_if(~F.col(n)).alias(f"dropped_{n}") for n in gates)).first()
    return out, r.asDict()


def in_order(pool: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, dict]:
    """(kept rows of ``pool``, counts): gates one after the other, each on the survivors of those before, so that a costly one sees few rows.

    A step returns (id, keep); an id that it does not know is kept.
    """
    out, counts = written(pool), {"n_in": None}
    counts["n_in"] = n = out.count()
    for name, gate in steps.items():
        dropped = gate(out).where(~F.col("keep")).select("id")
        out = written(out.join(dropped, "id", "left_anti"))
        left = out.count()
        counts[f"dropped_{name}"], n = n - left, left
    return out, {**counts, "n_kept": n}


class Pca:
    """Leading components of a reference set, from its covariance."""

    def __init__(self, reference: DataFrame, k: int = 50):
        self.mean, self.components, self.std = _fit(*setmetrics.covariance(reference), k)

    def project(self, df: DataFrame) -> DataFrame:
        """``df`` with ``z``, the centred coordinates."""
        mean, comp = self.mean, self.components
        return df.withColumn("z", _projected(mean, comp)("x"))

    def mahalanobis(self, df: DataFrame) -> DataFrame:
        """``df`` with ``d``: the diagonal Mahalanobis distance from the reference's centre."""
        ratio = F.zip_with("z", F.array(*(F.lit(float(s)) for s in self.std)), lambda a, s: (a / s) * (a / s))
        return self.project(df).withColumn("d", F.sqrt(F.aggregate(ratio, F.lit(0.0), lambda a, b: a + b))).drop("z")


def _projected(mean: np.ndarray, components: np.ndarray):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def project(x: pa.Array) -> pa.Array:
        z = (pairs.matrix(x) - mean) @ components if len(x) else np.zeros((0, components.shape[1]))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * components.shape[1]), pa.array(z.ravel()))

    return project


def mahalanobis_gate(pool: DataFrame, reference: DataFrame, drop: float = 0.05, k: int = 50) -> DataFrame:
    """(id, d, keep): drop the farthest share of the pool."""
    d = written(Pca(reference, k).mahalanobis(pool).select("id", "d"))
    return d.withColumn("keep", F.col("d") <= quantile(d, "d", 1 - drop))


def reference_threshold_gate(pool: DataFrame, reference: DataFrame, keep_pct: float = 95, k: int = 50) -> DataFrame:
    """(id, d, keep): keep what is as near as ``keep_pct`` percent of the reference itself."""
    pca = Pca(reference, k)
    thr = quantile(written(pca.mahalanobis(reference).select("d")), "d", keep_pct / 100)
    return pca.mahalanobis(pool).select("id", "d").withColumn("keep", F.col("d") <= thr)


class ClassPca:
    """Leading components of each class of a reference set, from counts, sums and products that one pass adds up by class.

    A class has d x d numbers, so classes are few; they are numbered on the driver.
    """

    def __init__(self, reference: DataFrame, cls: str, k: int = 50):
        self.cls, self.kind = cls, reference.schema[cls].dataType.simpleString()
        self.fits = {value: _fit(*m, k) for value, m in setmetrics.class_covariances(reference, cls).items()}

    def mahalanobis(self, df: DataFrame) -> DataFrame:
        """``df`` with ``d``: the diagonal Mahalanobis distance from the centre of the row's own class; rows of a class without a reference are left out."""
        names = list(self.fits)
        numbers = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(names)], f"_value {self.kind}, _k int")
        sent = df.sparkSession.sparkContext.broadcast([self.fits[v] for v in names])

        @F.arrow_udf(T.DoubleType())
        def distance(x: pa.Array, k: pa.Array) -> pa.Array:
            k, out = np.asarray(k), np.zeros(len(x))
            for one in np.unique(k):
                mean, components, std = sent.value[one]
                z = (pairs.matrix(x.filter(pa.array(k == one))) - mean) @ components
                out[k == one] = np.sqrt(np.square(z / std).sum(1))
            return pa.array(out)

        return df.join(F.broadcast(numbers), F.col(self.cls) == F.col("_value")).withColumn("d", distance("x", "_k")).drop("_value", "_k")  # a row a class


def _fit(n: int, mean: np.ndarray, cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, leading components and their standard deviations (n in the denominator)."""
    w, v = np.linalg.eigh(cov)
    k = min(k, len(w), n - 1)
    return mean, v[:, ::-1][:, :k], np.sqrt(np.maximum(w[::-1][:k], 0) * (n - 1) / n) + 1e-6


def class_threshold_gate(pool: DataFrame, reference: DataFrame, cls: str, keep_pct: float = 95, k: int = 50) -> DataFrame:
    """(id, class, d, threshold, keep): each class by its own components and by the distance that ``keep_pct`` percent of its own reference have.

    Rows of a class without a reference, and of no class, are left out.
    """
    pca = ClassPca(reference, cls, k)
    if not pca.fits:
        return pool.sparkSession.createDataFrame([], f"id long, {cls} {pca.kind}, d double, threshold double, keep boolean")
    own = written(pca.mahalanobis(reference).select(F.col(cls).alias("_c"), "d"))
    threshold = F.broadcast(quantiles(own, "d", [keep_pct / 100], ["_c"]).select("_c", F.col("value").alias("threshold")))  # a row a class
    rows = pca.mahalanobis(pool).select("id", cls, "d").join(threshold, F.col(cls) == F.col("_c"))
    return rows.select("id", cls, "d", "threshold", (F.col("d") <= F.col("threshold")).alias("keep"))


def nearest_share(scores: DataFrame, score: str, share: float = 0.9) -> DataFrame:
    """The rows with the lowest floor(share * n) scores, ties by id."""
    return scores.orderBy(score, "id").limit(int(share * scores.count()))
