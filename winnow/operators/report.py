"""Rankings, deltas, upserts and result documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, metric: str, descending: bool = True, name: str = "name") -> DataFrame:
    """``rows`` with ``rank`` from 1, ties by name; a report has a row a method, so one task ranks it."""
    order = F.col(metric).desc_nulls_last() if descending else F.col(metric).asc_nulls_last()
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(order, name)))


def flagged(rows: DataFrame, metric: str = "copy_rate", over: float = 0.10) -> DataFrame:
    return rows.withColumn("flag", F.coalesce(F.col(metric) > over, F.lit(False)))


def upsert_replace(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``new``, and those of ``old`` with other keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Column by column: the new value where there is one, else the old."""
    columns = [key, *[c for c in old.columns if c != key], *[c for c in new.columns if c not in old.columns]]
    o, n = old.alias("o"), new.alias("n")
    pick = lambda c: F.coalesce(*(F.col(f"{a}.{c}") for a, df in (("n", new), ("o", old)) if c in df.columns)).alias(c)
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*(pick(c) for c in columns))


def delta_vs_first(rows: DataFrame, order: str, metrics: list[str]) -> DataFrame:
    """``rows`` with each metric less that of the first row (``m_delta``)."""
    first = rows.agg(*(F.min_by(m, order).alias(f"_first_{m}") for m in metrics))
    out = rows.join(F.broadcast(first), F.lit(True), "left")  # one row
    return out.withColumns({f"{m}_delta": F.col(m) - F.col(f"_first_{m}") for m in metrics}).drop(*(f"_first_{m}" for m in metrics))


def pair_delta(rows: DataFrame, name: str, a: str, b: str, metrics: list[str]) -> DataFrame:
    """One row: the metrics of row ``b`` less those of row ``a``."""
    of = lambda m, x: F.max(F.when(F.col(name) == x, F.col(m)))
    return rows.agg(*((of(m, b) - of(m, a)).alias(f"{m}_delta") for m in metrics))


def explode_metrics(docs: DataFrame, column: str, value: str = "double") -> DataFrame:
    """A row for each entry of a JSON object column: (other columns, key, value)."""
    rest = [c for c in docs.columns if c != column]
    return docs.select(*rest, F.explode(F.from_json(column, f"map<string,{value}>")).alias("key", "value"))


def as_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """One JSON document a row."""
    return rows.select(F.to_json(F.struct("*")).alias(column))


def markdown(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(line_no, line) of a Markdown table, headed; numbers as they print."""
    bar = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = rows.select((F.row_number().over(Window.orderBy(order)) + 2).alias("line_no"), bar([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("line"))
    head = rows.sparkSession.createDataFrame([(1, f"| {' | '.join(columns)} |"), (2, "|" + "---|" * len(columns))], "line_no int, line string")
    return head.unionByName(body)


def class_summary(values: DataFrame, cls: str, value: str, over: float = 0.5) -> DataFrame:
    """(class, mean, std with n in the denominator, share over a bound, share missing, n): of ratios such as heart to chest width."""
    v = F.nullif(F.col(value), F.lit(float("nan")))
    return values.groupBy(cls).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.avg((v > over).cast("double")).alias("over"), F.avg(v.isNull().cast("double")).alias("missing"), F.count("*").alias("n"))


def retained(gap: Column, reference_gap: Column) -> Column:
    return gap / F.nullif(reference_gap, F.lit(0.0))
