"""Centroid clustering with Hamerly's bounds, in whole numbers.

Vectors become integers, so every distance, sum and new centroid is exact and a run gives the
same clusters wherever it runs. A table keeps for each vector its cluster, an upper bound of its
distance to that centroid and one lower bound of the distance to the second nearest. When the
centroids move, the bounds are loosened by how far they moved. As long as the upper bound is under the
lower one, or under half the distance from the centroid to the nearest other, the cluster can't
have changed. Else the upper bound is made exact, and a vector that is still in doubt is compared with all
centroids. Bounds are doubles, rounded away from each other, and decide only what to skip.

A round is one pass that writes the table anew and one that adds up each cluster in every task; the
driver gets a row for each task, cluster and nothing else, summed to ``k`` rows. Centroids are ``k`` rows
of ``size`` numbers, whatever the table.

A vector of another length, with a null or with a component that isn't finite is left out. Components are
held to 2^27 in either direction, so that distances fit in a long. A null id is clustered like any other
but never starts a centroid; repeated rows are vectors of their own, ordered by their numbers where ids are equal.
With fewer vectors than ``k`` there are as many centroids. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm._common import discard, materialise, table

SCALE = 1024
MOST = 1 << 27
ROUNDING = 1e-9
STATE = "vec_id long, v array<int>, cluster int, upper double, lower double, scans int, distance long"


def whole_numbers(x: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, held to ``MOST``."""
    return F.transform(x, lambda e: F.greatest(F.least(F.floor(e.cast("double") * scale), F.lit(MOST)), F.lit(-MOST)).cast("int"))


def kept(df: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """(vec_id, v) of the vectors with ``size`` finite components."""
    x = F.col(vec_col)
    finite = lambda e: F.coalesce(F.abs(e.cast("double")) < float("inf"), F.lit(False))
    return df.where((F.size(x) == size) & F.forall(x, finite)).select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(x).alias("v"))


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The first ``k`` vectors in the order of sha256 of ``<salt>:<vec_id>``."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").orderBy(order, "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, size)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exact."""
    return np.stack([np.square(x - c).sum(1) for c in centroids], 1) if len(centroids) else np.zeros((len(x), 0), np.int64)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid (ties: the smaller number), its squared distance, and the second nearest's; the latter is infinite for a lone centroid."""
    d = _distances(x, centroids)
    a = d.argmin(1)
    at = np.arange(len(x))
    first = d[at, a]
    if len(centroids) == 1:
        return a, first, np.full(len(x), np.inf)
    d[at, a] = np.iinfo(np.int64).max
    return a, first, d.min(1).astype(np.float64)


def assigned(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None, distances: bool = False) -> DataFrame:
    """``state`` with each vector in the cluster of its nearest centroid, written.

    ``before``: the centroids that the bounds belong to; None if there are no bounds yet. ``scans``: how often a vector was compared with all.
    """
    size = centroids.shape[1]
    moved = np.zeros(len(centroids)) if before is None else np.sqrt(np.square(centroids - before).sum(1).astype(np.float64)) * (1 + ROUNDING)
    others = np.array([np.delete(moved, i).max(initial=0.0) for i in range(len(centroids))])
    between = np.sqrt(_distances(centroids, centroids).astype(np.float64))
    half = np.array([np.delete(row, i).min(initial=np.inf) / 2 for i, row in enumerate(between)]) * (1 - ROUNDING)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b["v"], size)
            scans, distance = np.array(b["scans"]), np.zeros(len(x), np.int64)
            if before is None:
                a, u, l = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.full(len(x), -np.inf)
                doubt = np.arange(len(x))
            else:
                a, u, l = np.array(b["cluster"]).astype(np.int64), np.array(b["upper"]), np.array(b["lower"])
                u, l = (u + moved[a]) * (1 + ROUNDING), l * (1 - ROUNDING) - others[a]
                doubt = np.flatnonzero(u >= np.maximum(l, half[a]))
                u[doubt] = np.sqrt(np.square(x[doubt] - centroids[a[doubt]]).sum(1).astype(np.float64)) * (1 + ROUNDING)
                doubt = doubt[u[doubt] >= np.maximum(l, half[a])[doubt]]
            a[doubt], first, second = _nearest(x[doubt], centroids)
            u[doubt], l[doubt] = np.sqrt(first.astype(np.float64)) * (1 + ROUNDING), np.sqrt(second) * (1 - ROUNDING)
            scans[doubt] += 1
            if distances:
                distance = np.square(x - centroids[a]).sum(1)
            columns = [b["vec_id"], b["v"], pa.array(a.astype(np.int32)), pa.array(u), pa.array(l), pa.array(scans), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "cluster", "upper", "lower", "scans", "distance"])

    return materialise(state.mapInArrow(settle, STATE))


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean; one without vectors stays."""
    size, k = centroids.shape[1], len(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size + 1), np.int64)
        for b in batches:
            x, a = _matrix(b["v"], size), np.asarray(b["cluster"])
            for c in range(k):
                mine = x[a == c]
                total[c] += np.append(mine.sum(0), len(mine))
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at // (size + 1)), pa.array(at % (size + 1)), pa.array(total.ravel())], ["c", "i", "v"])

    sums = state.select("v", "cluster").mapInArrow(add, "c long, i long, v long").groupBy("c", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    by = {(r["c"], r["i"]): int(r["v"]) for r in sums.collect()}  # k x (size + 1) numbers
    out = centroids.copy()
    for c in range(k):
        if n := by.get((c, size), 0):
            out[c] = [by[c, i] // n for i in range(size)]
    return out


def clusters(df: DataFrame, id_col: str, vec_col: str, size: int = 64, k: int = 8, rounds: int = 10, salt: str = "3") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, scans) of each kept vector, written, and the centroids after ``rounds`` rounds."""
    vectors = kept(df, id_col, vec_col, size)
    centroids = seeds(vectors, k, salt)
    if not len(centroids):
        return df.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, scans int"), centroids
    none = F.lit(None)
    state, before = vectors.select("vec_id", "v", none.cast("int").alias("cluster"), none.cast("double").alias("upper"), none.cast("double").alias("lower"), F.lit(0).alias("scans"), none.cast("long").alias("distance")), None
    for at in range(rounds + 1):
        after = assigned(state, centroids, before, at == rounds)
        if at:
            discard(state)
        state = after
        if at < rounds:
            before, centroids = centroids, moved_centroids(state, centroids)
    return state.select("vec_id", "cluster", "distance", "scans"), centroids


def op13_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of every kept vector, with what its cluster and all clusters add up to."""
    rows, centroids = clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    names = [(c, hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()) for c, m in enumerate(centroids.tolist())]
    of = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = of.crossJoin(F.broadcast(rows.agg(F.sum("distance").alias("inertia"))))  # one row
    info = whole.join(F.broadcast(spark.createDataFrame(names, "cluster int, centroid_sha256 string")), "cluster")
    return rows.join(F.broadcast(info), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rounds: int = 10) -> str:
    """The rounds as a chain of tables, each comparing all vectors with all centroids."""
    parts = ["v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)"]
    parts.append("m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v AS m FROM v WHERE vec_id IS NOT NULL QUALIFY c < 8)")
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': c}}) AS a FROM (SELECT r, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, m{i}) GROUP BY r)")
        if i < rounds:
            parts.append(
                f"m{i + 1} AS MATERIALIZED (SELECT c, coalesce(f, m) AS m FROM m{i} LEFT JOIN (SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY i) AS f FROM (SELECT a.c AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM v JOIN a{i} USING (r), (SELECT unnest(range(1, 65)) AS i) GROUP BY a.c, i) GROUP BY c) USING (c))"
            )
    last = f"a{rounds}"
    return f"""WITH {", ".join(parts)}, f AS (SELECT vec_id, a.c AS c, a.d AS d, v FROM {last} JOIN v USING (r))
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM f JOIN m{rounds} USING (c)"""


OP13_SQL = _sql()
