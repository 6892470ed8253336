"""Exact order statistics and quantiles, of many ranks and groups at once, without sorting a column in one task.

Values are selected by refining histograms over the bits of a double: a pass counts, for each rank that is
sought, the next ``DIGIT`` bits of the values that agree with it so far, and steps into the bin that holds
the rank. So there are ``64 / DIGIT`` passes at most, whatever the ranks and groups. Where no bin has more than ``FEW`` rows,
its rows are ranked at once. The driver gets one number a pass. Null and NaN values are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.sources.scratch import written

DIGIT = 16
FEW = 1 << 16
SENT = 10_000  # targets, at most, that go to all tasks


@F.arrow_udf(T.LongType())
def ordered_bits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Longs in the order of the doubles; both zeros are one."""
    for v in batches:
        bits = (np.asarray(v, np.float64) + 0.0).view(np.int64)
        yield pa.array(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


@F.arrow_udf(T.DoubleType())
def from_ordered_bits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for v in batches:
        bits = np.asarray(v).astype(np.int64)
        yield pa.array((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


def _values(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    v = F.col(column).cast("double")
    group = F.struct(*by) if by else F.lit(0)
    return df.where(v.isNotNull() & ~F.isnan(v)).select(group.alias("g"), ordered_bits(v).alias("v"))


def _met(values: DataFrame, targets: DataFrame, prefix: Column) -> DataFrame:
    """``values`` with the bins (g, prefix) that targets are in."""
    bins = targets.select(F.col("g").alias("bin_g"), "prefix").distinct()
    if bins.limit(SENT + 1).count() <= SENT:
        bins = F.broadcast(bins)
    return values.join(bins, F.col("g").eqNullSafe(F.col("bin_g")) & (prefix == F.col("prefix"))).drop("bin_g")


def select_ranks(values: DataFrame, targets: DataFrame) -> DataFrame:
    """(g, rank, v) for targets (g, rank): the values (g, v) at 0-based ranks of their group, v as ordered bits.

    ``values`` are read once a pass, so they should be written.
    """
    # prefix: the leading bits that are settled; rest: the rank among the values that have them; size: how many these are
    sizes = values.groupBy(F.col("g").alias("size_g")).agg(F.count("*").alias("size"))
    todo = targets.join(sizes, F.col("g").eqNullSafe(F.col("size_g"))).select("g", "rank", F.lit(0).cast("long").alias("prefix"), F.col("rank").cast("long").alias("rest"), "size")
    shift = 64
    while True:
        todo = written(todo)
        settled = F.lit(0).cast("long") if shift == 64 else F.shiftright("v", shift)
        if shift == 0:
            return todo.select("g", "rank", F.col("prefix").alias("v"))
        most = todo.agg(F.max("size").alias("m")).first()["m"]
        if most is None:
            return todo.select("g", "rank", F.col("prefix").alias("v"))
        if most <= FEW:
            w = Window.partitionBy("g", "prefix").orderBy("v")
            placed = _met(values, todo, settled).withColumn("rest", (F.row_number().over(w) - 1).cast("long"))
            a, b = placed.alias("a"), todo.alias("b")
            same = F.col("a.g").eqNullSafe(F.col("b.g")) & (F.col("a.prefix") == F.col("b.prefix")) & (F.col("a.rest") == F.col("b.rest"))
            return a.join(b, same).select("b.g", "b.rank", "a.v")
        shift -= DIGIT
        counts = _met(values, todo, settled).groupBy("g", "prefix", F.shiftright("v", shift).alias("next")).agg(F.count("*").alias("n"))
        ahead = F.sum("n").over(Window.partitionBy("g", "prefix").orderBy("next")) - F.col("n")  # of at most 2 ** DIGIT bins
        a, b = counts.withColumn("ahead", ahead).alias("a"), todo.alias("b")
        inside = F.col("a.g").eqNullSafe(F.col("b.g")) & (F.col("a.prefix") == F.col("b.prefix")) & (F.col("b.rest") >= F.col("a.ahead")) & (F.col("b.rest") < F.col("a.ahead") + F.col("a.n"))
        todo = a.join(b, inside).select("b.g", "b.rank", F.col("a.next").alias("prefix"), (F.col("b.rest") - F.col("a.ahead")).alias("rest"), F.col("a.n").alias("size"))


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """The values at 0-based ranks of the non-null values in ascending order."""
    values = written(_values(df, column, []))
    targets = df.sparkSession.createDataFrame([(0, int(r)) for r in sorted(set(ranks))], "g int, rank long")
    found = {r["rank"]: r["v"] for r in select_ranks(values, targets).select("rank", from_ordered_bits("v").alias("v")).collect()}
    return [found[r] for r in ranks]


def quantiles(df: DataFrame, column: str, qs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, q, value) of each group that has values: by linear interpolation between order statistics."""
    by = by or []
    values = written(_values(df, column, by))
    sizes = written(values.groupBy("g").agg(F.count("*").alias("n")))
    at = F.col("q") * (F.col("n") - 1)
    wanted = sizes.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in qs)))).select("g", "q", F.floor(at).alias("lo"), F.ceil(at).alias("hi"), (at - F.floor(at)).alias("part"))
    wanted = written(wanted)
    ranks = wanted.select("g", F.explode(F.array("lo", "hi")).alias("rank")).distinct()
    found = written(select_ranks(values, ranks).select("g", "rank", from_ordered_bits("v").alias("v")))
    low, high = found.toDF("low_g", "low_rank", "low"), found.toDF("high_g", "high_rank", "high")
    rows = wanted.join(low, F.col("g").eqNullSafe(F.col("low_g")) & (F.col("lo") == F.col("low_rank"))).join(high, F.col("g").eqNullSafe(F.col("high_g")) & (F.col("hi") == F.col("high_rank")))
    return rows.select(*(F.col(f"g.{c}").alias(c) for c in by), "q", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("value"))


def _count(df: DataFrame, column: str) -> int:
    return df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()


def quantile(df: DataFrame, column: str, q: float) -> float | None:
    """By linear interpolation between order statistics; None without values."""
    n = _count(df, column)
    if not n:
        return None
    at = q * (n - 1)
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    low, high = order_statistics(df, column, [lo, hi])
    return low + (high - low) * (at - lo)


def lower_median(df: DataFrame, column: str) -> float | None:
    """The lower of the two middle values."""
    n = _count(df, column)
    return order_statistics(df, column, [(n - 1) // 2])[0] if n else None
