"""Compositions: gates and a selector over a pool, and tables that compare selectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.operators import gates, models, report, selectors, setmetrics
from winnow.sources.scratch import written


def gated_selection(pool: DataFrame, reference: DataFrame, n: int, selector: str = "herding", memorisation: float | None = None, mahalanobis: float | None = None, realism: float | None = 0.05, extra: dict[str, DataFrame] | None = None, **options) -> tuple[DataFrame, dict]:
    """(picks, report): gates with thresholds over the full pool, all of them ANDed, then a selector on what is left.

    ``memorisation``: percentile of the reference's spacing; ``mahalanobis`` and
    ``realism``: shares to drop; None leaves a gate out. ``extra``: more gates (id, keep) by name. Fewer survivors than ``n`` are an error.
    """
    by = {}
    if memorisation is not None:
        by["memorisation"], _ = gates.memorisation_gate(pool, reference, memorisation)
    if mahalanobis is not None:
        by["mahalanobis"] = gates.mahalanobis_gate(pool, reference, mahalanobis)
    if realism is not None:
        by["realism"] = gates.realism_gate(pool, reference, realism)
    marked, counts = gates.compose(pool, {**by, **(extra or {})})
    kept = written(marked.where("keep").select(*pool.columns))
    if counts["n_kept"] < n:
        raise ValueError(f"{counts['n_kept']} rows are left, fewer than n={n}")
    return selectors.select(selector, kept, reference, n, **options), {**counts, "selector": selector, "n": n}


def realism_rank(method: str, pool: DataFrame, reference: DataFrame, k: int = 50, neighbours: int = 5, seed: int = 0) -> DataFrame:
    """(id, score), lower is more real: ``maha``, ``knn`` (both on leading components) or ``disc``; ``given`` ranks in the space as it is."""
    if method == "disc":
        return models.forest_rank(reference, pool, seed=seed)
    if method == "given":
        return selectors.knn_rank(pool, reference, neighbours)
    pca = gates.Pca(reference, k)
    if method == "maha":
        return pca.mahalanobis(pool).select("id", F.col("d").alias("score"))
    if method == "knn":
        flat = lambda df: written(pca.project(df).select("id", F.col("z").alias("x")))
        return selectors.knn_rank(flat(pool), flat(reference), neighbours)
    raise ValueError(f"unknown method: {method}")


def compare(reference: DataFrame, kept: dict[str, DataFrame], subset_size: int = 1000, subsets: int = 100, k: int = 5) -> DataFrame:
    """A ranked row of metrics for each kept set (id, x); the report is as long as the list of sets."""
    rows = [{"name": name, **setmetrics.evaluate(reference, df, k, subset_size, subsets)} for name, df in kept.items()]
    columns = "name string, n long, fd double, kid double, kid_std double, coverage double, density double, recall double, vendi double, copy_rate double"
    names = [c.split()[0] for c in columns.split(", ")]
    frame = reference.sparkSession.createDataFrame([tuple(r[c] for c in names) for r in rows], columns)
    return report.flagged(report.ranked(frame, "coverage"))


def compare_filters(reference: DataFrame, pool: DataFrame, share: float = 0.66, methods: tuple[str, ...] = ("maha", "knn", "disc"), seed: int = 0) -> DataFrame:
    """Keep the most real share by each method, and all of it, scored by Fréchet distance, KID and a two-sample test."""
    n = max(2, round(share * pool.count()))
    sets = {"none": pool, **{m: written(pool.join(selectors.top_scores(realism_rank(m, pool, reference, seed=seed), "score", n, False).select("id"), "id", "left_semi")) for m in methods}}
    rows = []
    for name, df in sets.items():
        k = setmetrics.kid(reference, df, max(10, min(1000, reference.count() // 2, df.count() // 2)), seed=seed)
        rows.append((name, df.count(), setmetrics.frechet_distance(reference, df), k["kid"], models.c2st(reference, df, seed=seed)))
    return reference.sparkSession.createDataFrame(rows, "name string, n long, fd double, kid double, c2st double")


def ablation(pool: DataFrame, reference: DataFrame, n: int, selectors_: tuple[str, ...] = ("herding", "dpp", "kcenter", "random"), gate_sets: dict[str, dict] | None = None, options: dict[str, dict] | None = None, **measure) -> DataFrame:
    """A ranked row of metrics for each selector behind each set of gates (arguments of :func:`gated_selection`, by name)."""
    gate_sets = gate_sets or {"none": {"realism": None}, "realism": {"realism": 0.05}, "memorisation": {"memorisation": 1, "realism": None}, "both": {"memorisation": 1, "realism": 0.05}}
    kept = {}
    for gates_name, chosen in gate_sets.items():
        for name in selectors_:
            picks, _ = gated_selection(pool, reference, n, name, **chosen, **(options or {}).get(name, {}))
            kept[f"{name}+{gates_name}"] = written(pool.join(picks.select("id"), "id", "left_semi"))
    return compare(reference, kept, **measure)


def scored_elsewhere(picks: dict[str, DataFrame], pool: DataFrame, reference: DataFrame, **measure) -> DataFrame:
    """Selections made in one space (id), scored by the vectors (id, x) that the same records have in another."""
    return compare(reference, {name: written(pool.join(ids.select("id"), "id", "left_semi")) for name, ids in picks.items()}, **measure)


def nearest_then_herd(pool: DataFrame, reference: DataFrame, n: int, drop: float = 0.1, k: int = 50, **options) -> DataFrame:
    """Drops the share that is farthest from the reference by Mahalanobis distance, and herds on the rest."""
    d = written(gates.Pca(reference, k).mahalanobis(pool).select("id", "d"))
    kept = written(pool.join(gates.nearest_share(d, "d", 1 - drop).select("id"), "id", "left_semi"))
    return selectors.herding(kept, reference, n, **options)


def union_of(parts: dict[str, DataFrame], column: str = "provenance") -> DataFrame:
    """All rows, with the name of the set that they come from."""
    return reduce(lambda a, b: a.unionByName(b), (df.withColumn(column, F.lit(name)) for name, df in parts.items()))
