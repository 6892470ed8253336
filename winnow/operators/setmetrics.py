"""Metrics between a reference set and a candidate set of vectors, both (id, x)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.order import seeded
from winnow.functions.vectors import dot, norm, unit
from winnow.operators import moments, pairs
from winnow.operators.quantiles import lower_median, quantile
from winnow.operators.sampling import sample_n, subset_draws
from winnow.sources.scratch import written


def _mean(df: DataFrame, column: str) -> float:
    return df.agg(F.avg(column).alias("v")).first()["v"]


def median_sigma(df: DataFrame, most: int = 2000, seed: int = 0) -> float:
    """The lower median distance of pairs of at most ``most`` sampled vectors; 1 if that is 0 or there is no pair."""
    sample = written(sample_n(df, most, seed).select("id", "x"))
    near = pairs.nearest(sample, sample, most, skip_same=True)
    # every pair twice, which leaves the lower median where it is
    return lower_median(near.select(F.explode("near.d").alias("d")), "d") or 1.0


def mmd2(candidates: DataFrame, reference: DataFrame, **kernel) -> dict:
    """mean k(S, S) + mean k(R, R) - 2 mean k(S, R): with the pairs of a vector with itself (biased) and without (unbiased).

    A polynomial kernel takes one pass a set (:mod:`moments`) where the dimension allows, any other all pairs.
    """
    degree = kernel.get("degree", 3)
    width = moments.width_of(candidates) if kernel.get("name", "poly") == "poly" else 0
    if moments.fits(width, degree):
        s, r = moments.moments_of(candidates, width, degree), moments.moments_of(reference, width, degree)
        if s is None or r is None:
            return {"biased": float("nan"), "unbiased": float("nan")}
        across = 2 * s.with_all(r, degree)
        own = {id(x): x.with_all(x, degree) for x in (s, r)}
        others = lambda x: (own[id(x)] * x.n**2 - x.own) / (x.n * (x.n - 1)) if x.n > 1 else float("nan")
        return {"biased": own[id(s)] + own[id(r)] - across, "unbiased": others(s) + others(r) - across}
    total = {}
    for name, a, b in (("ss", candidates, candidates), ("rr", reference, reference), ("sr", candidates, reference)):
        total[name] = pairs.kernel_sums(a, b, **kernel).agg(*(F.sum(c).alias(c) for c in ("s", "n", "own", "same"))).first()
    mean = lambda r: r["s"] / r["n"] if r["n"] else float("nan")
    others = lambda r: (r["s"] - r["own"]) / (r["n"] - r["same"]) if r["n"] and r["n"] > r["same"] else float("nan")
    across = 2 * mean(total["sr"])
    return {"biased": mean(total["ss"]) + mean(total["rr"]) - across, "unbiased": others(total["ss"]) + others(total["rr"]) - across}


def mmd2_biased(candidates: DataFrame, reference: DataFrame, **kernel) -> float:
    return mmd2(candidates, reference, **kernel)["biased"]


def mmd2_unbiased(candidates: DataFrame, reference: DataFrame, **kernel) -> float:
    return mmd2(candidates, reference, **kernel)["unbiased"]


def kid(reference: DataFrame, candidates: DataFrame, subset_size: int = 1000, subsets: int = 100, degree: int = 3, seed: int = 0) -> dict:
    """Mean and standard deviation (n in the denominator) of the unbiased MMD^2 over seeded subsets.

    A draw of subset_size vectors of each side is a group of one task, at most.
    """
    size = min(subset_size, reference.count(), candidates.count())
    if size < 2:
        return {"kid": float("nan"), "kid_std": float("nan"), "subset_size": size, "subsets": subsets}
    a, b = (subset_draws(df.select("id", "x"), subsets, size, f"{seed}{side}") for df, side in ((reference, "r"), (candidates, "f")))

    def one(left, right):
        x, y = (np.stack(p.sort_values(key)[col].to_numpy()) for p, key, col in ((left, "id", "x"), (right, "id2", "x2")))
        xx, yy, xy = (pairs.kernel_matrix(p, q, "poly", degree) for p, q in ((x, x), (y, y), (x, y)))
        off = lambda k: (k.sum() - np.trace(k)) / (len(k) * (len(k) - 1))
        return pd.DataFrame({"subset": [int(left["subset"].iloc[0])], "mmd2": [off(xx) + off(yy) - 2 * xy.mean()]})

    b = b.select(F.col("subset").alias("subset2"), F.col("id").alias("id2"), F.col("x").alias("x2"))
    values = a.groupBy("subset").cogroup(b.groupBy("subset2")).applyInPandas(one, "subset int, mmd2 double")
    r = values.agg(F.avg("mmd2").alias("kid"), F.stddev_pop("mmd2").alias("kid_std")).first()
    return {"kid": r["kid"], "kid_std": r["kid_std"], "subset_size": size, "subsets": subsets}


BALLS_OF = 2048  # reference vectors that bound the balls at first


def coverage_density(reference: DataFrame, candidates: DataFrame, k: int = 5) -> dict:
    """The share of reference balls with a candidate in them, and how many balls hold a candidate, over k."""
    return coverage_densities(reference, {"": candidates}, k)[""]


def coverage_densities(reference: DataFrame, sets: dict[str, DataFrame], k: int = 5) -> dict[str, dict]:
    """:func:`coverage_density` of several sets of candidates; balls are made once for all.

    Where candidates are few, most balls hold none, and that can be told without their radius: it is at most the distance to the k-th
    nearest vector of any part of the reference. Parts that grow by eight are tried on the balls that are still open, and
    only those that stay open get their radius by all vectors. Results are those of all balls.
    """
    n, sizes = reference.count(), {name: df.count() for name, df in sets.items()}
    rest, closed = reference.select("id", "x"), 0
    if 16 * sum(sizes.values()) <= n and sum(sizes.values()):
        near = None
        for df in sets.values():
            one = to_reference(reference, df)
            near = one if near is None else near.unionByName(one)
        near = near.groupBy("id").agg(F.min("d").alias("d"))
        part, rest = BALLS_OF, written(rest.join(near, "id", "left"))
        left = n
        while 8 * part <= n and left:
            some = written(reference.orderBy(seeded(0, "id"), "id").limit(part).select("id", "x"))
            found = pairs.nearest(rest, some, k, skip_same=True).where(F.size("near") >= k).select("id", F.element_at("near", k)["d"].alias("most"))
            open_ = written(rest.join(found, "id", "left").where("d IS NULL OR most IS NULL OR d <= most * (1 + 1e-9)").drop("most"))
            before, left = left, open_.count()
            closed, rest, part = closed + before - left, open_, 8 * part
    near = pairs.nearest(rest, reference, k, skip_same=True).where(F.size("near") > 0)
    balls = written(rest.join(near.select("id", F.element_at("near", -1)["d"].alias("radius")), "id").select("id", "x", "radius"))
    n_balls = closed + balls.count()
    k = min(k, n_balls - 1)
    out = {}
    for name, df in sets.items():
        r = pairs.inside_counts(balls, df).agg(F.count_if(F.col("n") > 0).alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first()
        out[name] = {"coverage": round(r["c"] / n_balls, 4), "density": round(r["s"] / (k * sizes[name]), 4), "k": k}
    return out


def recall(reference: DataFrame, candidates: DataFrame, k: int = 5) -> dict:
    """The share of reference vectors in the ball of a candidate."""
    balls = written(pairs.radii(candidates, k))
    n = pairs.inside_counts(reference, balls, radius_of="right")
    return {"recall": round(_mean(n.select((F.col("n") > 0).cast("double").alias("v")), "v"), 4), "k": min(k, candidates.count() - 1)}


def spacing(reference: DataFrame) -> DataFrame:
    """(id, d): the distance of each vector to the nearest other."""
    return pairs.nearest(reference, reference, 1, skip_same=True).where(F.size("near") > 0).select("id", F.col("near")[0]["d"].alias("d"))


def to_reference(candidates: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, d): the distance of each candidate to the nearest reference vector."""
    return pairs.nearest(candidates, reference, 1).select("id", F.col("near")[0]["d"].alias("d"))


def copy_rate(reference: DataFrame, candidates: DataFrame, pct: float = 5) -> dict:
    """The share of candidates nearer to the reference than its own ``pct``-th percentile of spacing; NaN for under three or no vectors."""
    nr, nf = reference.count(), candidates.count()
    if nr < 3 or nf < 1:
        return {"copy_rate": float("nan"), "tau": float("nan"), "reference_rows": nr, "candidate_rows": nf}
    own, theirs = written(spacing(reference)), written(to_reference(candidates, reference))
    tau = quantile(own, "d", pct / 100)
    rate = _mean(theirs.select((F.col("d") < tau).cast("double").alias("v")), "v")
    return {"copy_rate": round(rate, 4), "tau": round(tau, 3), "pct": pct, "candidate_median": round(lower_median(theirs, "d"), 3), "reference_median": round(lower_median(own, "d"), 3), "reference_rows": nr, "candidate_rows": nf}


def _sums(df: DataFrame, d: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, mean and covariance (n - 1) of each class of (k int, x), from sums that every task adds up; a class has d x d numbers, whatever the rows."""

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            k, whole = np.asarray(b.column(0)), pairs.matrix(b.column(1))
            for one in np.unique(k):
                x = whole[k == one]
                flat = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                total[int(one)] = total[int(one)] + flat if int(one) in total else flat
        for one, flat in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), one, np.int32)), pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "i", "v"])

    t = df.select("k", "x").mapInArrow(sums, "k int, i long, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).toArrow()
    out, k = {}, np.asarray(t["k"])
    for one in np.unique(k):
        flat = np.zeros(1 + d + d * d)
        flat[np.asarray(t["i"])[k == one]] = np.asarray(t["v"])[k == one]
        n, mean = int(flat[0]), flat[1 : d + 1] / flat[0]
        out[int(one)] = n, mean, (flat[d + 1 :].reshape(d, d) - n * np.outer(mean, mean)) / max(1, n - 1)
    return out


def covariance(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance (n - 1)."""
    first = df.select("x").first()
    if first is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    return _sums(df.select(F.lit(0).alias("k"), "x"), len(first["x"]))[0]


def class_covariances(df: DataFrame, cls: str) -> dict:
    """Count, mean and covariance of each class that isn't null, in one pass over all classes."""
    values = [r[0] for r in df.where(F.col(cls).isNotNull()).select(cls).distinct().orderBy(cls).collect()]
    if not values:
        return {}
    numbers = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], f"_value {df.schema[cls].dataType.simpleString()}, k int")
    rows = df.join(F.broadcast(numbers), F.col(cls) == F.col("_value"))  # a row a class
    d = df.select("x").first()
    return {values[k]: m for k, m in _sums(rows.select("k", "x"), len(d["x"])).items()}


def _root(s: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh(s)
    return (v * np.sqrt(np.maximum(w, 1e-12))) @ v.T


def frechet_distance(reference: DataFrame, candidates: DataFrame, eps: float = 1e-6) -> float:
    """Between the normal distributions of both sets."""
    (_, ma, a), (_, mb, b) = covariance(reference), covariance(candidates)
    a, b = a + eps * np.eye(len(ma)), b + eps * np.eye(len(mb))
    root = _root(a)
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ b @ root), 0)).sum()
    return float(max(0.0, ((ma - mb) ** 2).sum() + np.trace(a) + np.trace(b) - 2 * cross))


RBF_ROWS = 4000
LANDMARKS = 1024
_ROWS = 2048  # vectors that meet the landmarks at a time


def _entropy(w: np.ndarray) -> float:
    return float(-(w * np.log(np.maximum(w, 1e-300))).sum())


def _spread(eigenvalues: np.ndarray) -> float:
    """exp of the entropy of eigenvalues scaled to a sum of 1."""
    w = np.maximum(eigenvalues, 0)
    w = w / max(w.sum(), 1e-12)
    return round(float(np.exp(-(w * np.log(np.maximum(w, 1e-12))).sum())), 4)


def entropy_bounds(known: np.ndarray, n: int) -> tuple[float, float]:
    """The least and the largest entropy of n eigenvalues of sum 1, of which none is under its place in ``known``; others are 0 or more.

    What is missing from 1 adds least if all of it goes to the largest, and most if the smallest are filled up to one level.
    """
    known = np.sort(known)
    rest = max(0.0, 1.0 - known.sum())
    top = known[-1:]
    low = _entropy(known) + _entropy(top + rest) - _entropy(top)
    filled = n - len(known) + np.arange(len(known) + 1)
    level = (rest + np.concatenate([[0.0], np.cumsum(known)])) / np.maximum(filled, 1)
    k = int(np.flatnonzero((filled > 0) & (level <= np.append(known, np.inf)))[0])
    return low, filled[k] * _entropy(level[k : k + 1]) + _entropy(known[k:])


def _meetings(df: DataFrame, landmarks: np.ndarray, sigma: float) -> np.ndarray:
    """The sum over all vectors of the outer product of their rbf kernel values with ``landmarks``: a task adds up its own, then rows of the matrix are added across tasks."""
    r = len(landmarks)

    def sums(batches):
        total = np.zeros((r, r))
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                c = pairs.kernel_matrix(pairs.matrix(b.column(0).slice(at, _ROWS)), landmarks, "rbf", sigma=sigma)
                total += c.T @ c
        for i in range(0, r, 64):
            some = total[i : i + 64]
            offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * r)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(some), dtype=np.int32)), pa.ListArray.from_arrays(offsets, pa.array(some.ravel()))], ["i", "v"])

    def add(rows: pa.Table) -> pa.Table:
        return pa.table({"i": rows["i"][:1], "v": pa.array([pairs.matrix(rows["v"]).sum(0).tolist()], pa.list_(pa.float64()))})

    kind = "i int, v array<double>"
    rows = df.select("x").mapInArrow(sums, kind).groupBy("i").applyInArrow(add, kind).toArrow().sort_by("i")
    return pairs.matrix(rows["v"])


def _rbf_bounds(df: DataFrame, n: int, sigma: float, landmarks: int, seed: int) -> tuple[float, float]:
    """The least and the largest entropy of the rbf kernel's eigenvalues over n.

    The kernel matrix less its projection on the columns of some vectors has no negative eigenvalue, so the projection's
    eigenvalues are lower bounds one by one, and what its trace lacks is known.
    """
    z = pairs.matrix(df.orderBy(seeded(seed, "id"), "id").select("x").limit(landmarks).toArrow()["x"])
    w, u = np.linalg.eigh(pairs.kernel_matrix(z, z, "rbf", sigma=sigma))
    used = w > 1e-9 * w.max()
    half = u[:, used] / np.sqrt(w[used])
    found = np.linalg.eigvalsh(half.T @ _meetings(df, z, sigma) @ half) / n
    return entropy_bounds(np.clip(found, 0, 1), n)


def vendi_score(df: DataFrame, kernel: str = "cosine", sigma: float | None = None, landmarks: int = LANDMARKS, seed: int = 0) -> dict:
    """The effective number of distinct vectors under the cosine or the rbf kernel.

    Cosine: the n x n kernel matrix over n and the d x d mean of outer products have the same
    eigenvalues past zero, so only the latter is formed. The rbf kernel has no such form: up to ``RBF_ROWS``
    vectors its whole matrix is made. For more, one pass compares all vectors with ``landmarks`` of them, which a hash of
    the seed and the id chooses; ``low`` and ``high`` then hold the exact score between them and ``vendi`` is their
    geometric mean. More landmarks bring them together. ``sigma``: the median distance if not given.
    """
    if kernel == "cosine":
        n, mean, cov = covariance(df.select(unit(F.col("x")).alias("x")))
        return {"vendi": _spread(np.linalg.eigvalsh(cov * (n - 1) / n + np.outer(mean, mean))) if n else float("nan"), "n": n}
    if kernel != "rbf":
        raise ValueError(f"unknown kernel: {kernel}")
    n = df.count()
    if n > RBF_ROWS:
        low, high = _rbf_bounds(df, n, sigma or median_sigma(df), landmarks, seed)
        return {"vendi": round(float(np.exp((low + high) / 2)), 4), "low": round(float(np.exp(low)), 4), "high": round(float(np.exp(high)), 4), "n": n}
    x = pairs.matrix(df.orderBy("id").select("x").toArrow()["x"])
    exact = _spread(np.linalg.eigvalsh(pairs.kernel_matrix(x, x, "rbf", sigma=sigma or median_sigma(df)) / n)) if n else float("nan")
    return {"vendi": exact, "low": exact, "high": exact, "n": n}


def feature_parity(a: DataFrame, b: DataFrame) -> dict:
    """How far two extractions (id, x) of the same records agree: common ids, the largest absolute difference and the least cosine."""
    both = a.select("id", F.col("x").alias("p")).join(b.select("id", F.col("x").alias("q")), "id")
    gap = F.array_max(F.zip_with("p", "q", lambda x, y: F.abs(x - y)))
    cosine = dot(F.col("p"), F.col("q")) / F.greatest(norm(F.col("p")) * norm(F.col("q")), F.lit(1e-12))
    r = both.agg(F.count("*").alias("n"), F.max(gap).alias("gap"), F.min(cosine).alias("cosine")).first()
    return {"n": r["n"], "max_difference": r["gap"], "min_cosine": r["cosine"]}


def inception_score(probabilities: DataFrame, seed: int = 0) -> tuple[float, float]:
    """Mean and deviation over splits of exp(mean KL of class probabilities (id, p) to the split's mean)."""
    n = probabilities.count()
    splits = 10 if n >= 20 else max(1, n // 2)
    rows = probabilities.withColumn("s", F.pmod(F.conv(F.substring(seeded(seed, "id"), 1, 8), 16, 10).cast("long"), F.lit(splits))).select("id", "s", F.posexplode("p").alias("c", "p"))
    mean = rows.groupBy("s", "c").agg(F.avg("p").alias("m"))
    term = F.when(F.col("p") > 0, F.col("p") * (F.log("p") - F.log("m"))).otherwise(0.0)
    kl = rows.join(mean, ["s", "c"]).groupBy("s", "id").agg(F.sum(term).alias("kl")).groupBy("s").agg(F.exp(F.avg("kl")).alias("v"))
    r = kl.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d")).first()
    return r["m"], r["d"]


def evaluate(reference: DataFrame, candidates: DataFrame, k: int = 5, subset_size: int = 1000, subsets: int = 100, seed: int = 0) -> dict:
    """All metrics of one candidate set."""
    return {"n": candidates.count(), "fd": round(frechet_distance(reference, candidates), 3), **{c: round(v, 6) for c, v in kid(reference, candidates, subset_size, subsets, seed=seed).items() if c.startswith("kid")}, **{c: v for c, v in coverage_density(reference, candidates, k).items() if c != "k"}, "recall": recall(reference, candidates, k)["recall"], "vendi": vendi_score(candidates)["vendi"], "copy_rate": copy_rate(reference, candidates)["copy_rate"]}
