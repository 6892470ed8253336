"""Seeded samples, splits and balances. Ties in the seeded order go by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.order import seeded, uniform
from winnow.sources.scratch import written

SENT = 1_000_000  # drawn ids, at most, that go to all tasks


def sample_n(df: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """``n`` rows without replacement; all if there are fewer."""
    return df.orderBy(seeded(seed, key), key).limit(n)


def sample_weighted(df: DataFrame, n: int, weight: Column, seed: int = 0, key: str = "id") -> DataFrame:
    """``n`` rows without replacement, drawn in proportion to ``weight`` (exponential keys); rows without positive weight never."""
    return df.withColumn("_w", weight).where("_w > 0").orderBy(-F.log(uniform(seed, key)) / F.col("_w"), key).limit(n).drop("_w")


def sample_by_logit(df: DataFrame, n: int, logit: str, seed: int = 0, key: str = "id") -> DataFrame:
    """Weighted by exp(logit - greatest logit)."""
    top = df.agg(F.max(logit).alias("m")).first()["m"]
    return sample_weighted(df, n, F.exp(F.col(logit) - F.lit(top or 0.0)), seed, key)


def rank_in_class(cls: str, seed: int = 0, key: str = "id") -> Column:
    return F.row_number().over(Window.partitionBy(cls).orderBy(seeded(seed, key), key))


def class_sizes(df: DataFrame, cls: str) -> DataFrame:
    return df.groupBy(cls).agg(F.count("*").alias("n"))


def smallest_class(df: DataFrame, cls: str) -> int:
    return class_sizes(df, cls).agg(F.min("n").alias("n")).first()["n"] or 0


def _cutoffs(df: DataFrame, cls: str, want: DataFrame, seed: int | str, *key: str) -> DataFrame:
    """``df`` with ``_at``, a row's place in its class's seeded order, computed without one task a class.

    A class is dealt into buckets of the leading hex digits of its order key; the
    buckets' sizes give each bucket's first place, and only rows inside a bucket are ranked.
    """
    rows = df.join(want, df[cls].eqNullSafe(want["_c"])).withColumn("_h", seeded(seed, *key)).withColumn("_b", F.substring("_h", 1, 3))
    sizes = rows.groupBy("_c", "_b").agg(F.count("*").alias("_n"))
    first = F.coalesce(F.sum("_n").over(Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("_c").alias("_c2"), F.col("_b").alias("_b2"), first.alias("_first"))
    inner = F.row_number().over(Window.partitionBy("_c", "_b").orderBy("_h", *key))
    rows = rows.withColumn("_r", inner).join(sizes, F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("_b") == F.col("_b2")))
    return rows.withColumn("_at", F.col("_r") + F.col("_first"))


def n_per_class(df: DataFrame, cls: str, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """The first ``n`` rows of each class in the seeded order."""
    want = class_sizes(df, cls).select(F.col(cls).alias("_c"))
    return _cutoffs(df, cls, want, seed, key).where(F.col("_at") <= n).select(*df.columns)


def balance(df: DataFrame, cls: str, seed: int = 0, key: str = "id") -> DataFrame:
    """As many rows of each class as the smallest has."""
    return n_per_class(df, cls, smallest_class(df, cls), seed, key)


def split_halves(df: DataFrame, cls: str, seed: int = 0, key: str = "id", least: int = 4) -> DataFrame:
    """``df`` with ``part``: ``select`` for the first half of each class in the seeded order, ``eval`` for the rest.

    A class under ``least`` rows is an error.
    """
    sizes = class_sizes(df, cls)
    if sizes.where(F.col("n") < least).limit(1).count():
        raise ValueError(f"a class has fewer than {least} rows")
    want = sizes.select(F.col(cls).alias("_c"), F.col("n").alias("_size"))
    part = F.when(F.col("_at") <= F.floor(F.col("_size") / 2), "select").otherwise("eval")
    return _cutoffs(df, cls, want, seed, key).withColumn("part", part).select(*df.columns, "part")


def subset_draws(df: DataFrame, subsets: int, size: int, seed: int | str = 0, key: str = "id") -> DataFrame:
    """``subsets`` independent draws of ``size`` rows (all, if there are fewer), told apart by ``subset`` (from 0).

    A draw is the first ``size`` ids in its own seeded order. Ids whose order key is past a threshold can't be among
    them, so a task lets only some ``size`` ids of a subset through, and rows are joined to the ids that are drawn. A threshold
    that was too low for a subset is raised.
    """
    ids, n = df.select(key), df.count()
    orders = ids.withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(subsets - 1)))).withColumn("_h", seeded(seed, "subset", key))
    share = min(1.0, (size + 8 * size**0.5 + 16) / max(1, n))
    while True:
        near = orders if share >= 1 else orders.where(F.col("_h") < f"{int(share * (1 << 52)):013x}")
        near = written(near)
        counts = near.groupBy("subset").agg(F.count("*").alias("n")).agg(F.count("*").alias("subsets"), F.min("n").alias("n")).first()
        if share >= 1 or counts["subsets"] == subsets and counts["n"] >= size:
            break
        share = min(1.0, share * 2)
    w = Window.partitionBy("subset").orderBy("_h", key)  # of about ``size`` rows
    drawn = near.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= size).select("subset", key)
    if subsets * size <= SENT:
        drawn = F.broadcast(drawn)
    return df.join(drawn, key)


def head_per_class(df: DataFrame, cls: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each class by a column."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(cls).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def take_first(df: DataFrame, order: str, n: int) -> DataFrame:
    """The head of a sorted list."""
    return df.orderBy(order).limit(n)


def numbered(df: DataFrame, order: str, out: str = "row") -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of a column: sorted by ranges, so that no task has all rows."""
    staged = written(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_pos", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_pos", 33)))
    sizes = staged.groupBy("_part").agg(F.count("*").alias("n"))
    # a row a partition
    ahead = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    place = F.col("_ahead") + F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    return staged.join(F.broadcast(ahead), "_part").withColumn(out, place).drop("_pos", "_part", "_ahead")
