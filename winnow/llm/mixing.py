"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a seeded order, served again from the
start up to ``epochs`` times. A document's virtual finish time is the words its
queue has served up to and with it, divided by the queue's weight. All entries are
range-sorted by finish time over the whole input and the list is cut at the budget
(the sum of all sizes). A queue that is served out leaves its share to the others
by weight, so the words taken follow the water-filled targets.

Nulls: a null source is a source of its own, last in order; a null size counts as 0.
A document of size 0 is never taken (there is nothing to take). Ties in the finish
time go by source order, pass, order hash, id and size; rows equal in all of these
are interchangeable, each has its own place in the queue. An empty input gives no
rows; a budget of 0 takes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from winnow.llm._common import fresh, materialise, row_hash, small, table

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 3
BUCKET_ROWS = 4096


def n_words(text: Column) -> Column:
    """Runs of characters other than space and \\x09-\\x0D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """From (src, source_size), a row a source: adds rank, weight, budget and target.

    The water level is the largest of (budget - caps of the sources filled before)
    / (weights not yet filled), sources in the order they fill up.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())).cast("long"))
    w = F.array(*(F.lit(float(x)) for x in weights))
    ranked = ranked.withColumn("weight", F.element_at(w, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))).withColumn("budget", F.sum("source_size").over(everything)).withColumn("cap", F.col("source_size") * epochs)
    fills = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    left = F.col("budget") - F.coalesce(F.sum("cap").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = left.cast("double") / F.sum("weight").over(fills.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))).drop("level", "cap")


def weighted_fair_mix(df: DataFrame, id_col: str, source_col: str, size_col: str, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 7, outputs: tuple[str, str, str] = ("source_size", "target", "copies")) -> DataFrame:
    """``df`` with its source's size (long) and target (double), and the passes in which the mix takes the row (long, 0 to epochs).

    ``outputs`` names the three; input columns of these names are replaced. One shuffle carries the rows by
    (source, bucket of the order hash), where buckets grow with the source, so that
    no source and no id is one task; everything else is narrow.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = df.select(
        F.struct(*(f"`{c}`" for c in df.columns)).alias("row"), F.col(source_col).alias("src"), F.col(id_col).alias("id"), row_hash(df).alias("tie"),
        F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("words"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("hash"),
    )
    per_source = rows.groupBy("src").agg(F.sum("words").alias("source_size"), F.count("*").alias("n"))
    sources = materialise(source_targets(per_source, weights, epochs))
    plan = sources.select(F.col("src").alias("s"), "source_size", "target", "n", F.col("rank").alias("r"), "weight")
    bucket = F.shiftright(F.shiftright("hash", 30) * F.ceil(F.col("n") / BUCKET_ROWS).cast("long"), 30)
    rows = rows.join(small(plan), F.col("src").eqNullSafe(F.col("s"))).withColumn("bucket", bucket).drop("s", "src", "n")
    queue = Window.partitionBy("r", "bucket").orderBy("hash", F.col("id").asc_nulls_last(), "words", "tie")
    rows = materialise(rows.withColumn("inner", F.sum("words").over(queue.rowsBetween(Window.unboundedPreceding, 0))).drop("tie"))
    buckets = rows.groupBy("r", "bucket").agg(F.sum("words").alias("all"))
    earlier = Window.partitionBy("r").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = materialise(buckets.select("r", "bucket", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("outer")))
    rows = rows.join(small(buckets), ["r", "bucket"]).withColumn("served", F.col("inner") + F.col("outer"))

    finish = lambda e: (e * F.col("source_size") + F.col("served")).cast("double") / F.col("weight")
    keys = ["finish", "r", "pass", "hash", "id", "words"]
    entries = rows.where(F.col("words") > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    entries = entries.select(finish(F.col("pass")).alias("finish"), *keys[1:])
    budget = sources.agg(F.max("budget").alias("b")).first()["b"]
    cut = _cut(entries, keys, budget) if budget else None

    def taken(e: int) -> Column:
        if cut is None:
            return F.lit(0).cast("long")
        mine = [finish(F.lit(e)), F.col("r"), F.lit(e), F.col("hash"), F.col("id"), F.col("words")]
        ahead, same = F.lit(False), F.lit(True)
        for a, b in zip(mine, (F.lit(cut[k]) for k in keys)):
            ahead = ahead | (same & F.coalesce((a < b) | (a.isNotNull() & b.isNull()), F.lit(False)))
            same = same & a.eqNullSafe(b)
        return ((F.col("words") > 0) & (ahead | same)).cast("long")

    copies = reduce(lambda x, y: x + y, (taken(e) for e in range(epochs)))
    named = {c.lower() for c in outputs}
    kept = [F.col(f"row.`{c}`") for c in df.columns if c.lower() not in named]
    return rows.select(*kept, F.col("source_size").alias(outputs[0]), F.col("target").alias(outputs[1]), copies.alias(outputs[2]))


def _cut(entries: DataFrame, keys: list[str], budget: int) -> Row | None:
    """The last entry, in the order of ``keys``, up to which all words fit the budget; None if the first does not.

    The entries are range-sorted and written with their place; sums per partition
    tell in which partition the budget ends, and only that one is summed row by row.
    One row comes back to the driver.
    """
    order = [F.col(k).asc_nulls_last() for k in keys]
    staged = entries.withColumn("scan", F.monotonically_increasing_id()).repartitionByRange(*order, "scan").sortWithinPartitions(*order, "scan").drop("scan")
    staged = materialise(staged.withColumn("pos", F.monotonically_increasing_id())).withColumn("part", F.shiftright("pos", 33))
    sums = staged.groupBy("part").agg(F.sum("words").alias("w"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("w").over(upto))
    end = sums.where(F.col("upto") > budget).agg(F.min_by(F.struct("part", (F.col("upto") - F.col("w")).alias("start")), "part").alias("end")).first()["end"]
    last = F.max_by(F.struct(*keys), "pos").alias("cut")
    if end is None:  # everything fits
        return staged.agg(last).first()["cut"]
    running = F.lit(end["start"]) + F.sum("words").over(Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    here = staged.where(F.col("part") == end["part"]).withColumn("running", running).where(F.col("running") <= budget).agg(last).first()["cut"]
    return here or staged.where(F.col("part") < end["part"]).agg(last).first()["cut"]


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, repeated once a pass; columns as before."""
    size, again, *outputs = fresh(docs, "n_words", "again", "source_size", "target", "copies")
    mixed = weighted_fair_mix(docs.withColumn(size, n_words(F.col("text"))), "doc_id", "source", size, outputs=tuple(outputs))
    return mixed.where(F.col(outputs[2]) > 0).withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(outputs[2])))).select(*(f"`{c}`" for c in docs.columns))


def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents: weights 5, 2, 1 by source, up to three passes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = weighted_fair_mix(docs, "doc_id", "source", "size")
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
t AS (
  SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         sum(source_size) OVER ()::BIGINT AS budget, (source_size * 3)::BIGINT AS cap FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM t),
g AS (SELECT *, least(cap::DOUBLE, weight * max(lv) OVER ()) AS target FROM l),
q AS (
  SELECT d.doc_id, d.size, d.h, g.*, row_number() OVER (ORDER BY g.rk, h, d.doc_id, d.size) AS k,
         sum(d.size) OVER (PARTITION BY g.rk ORDER BY h, d.doc_id NULLS LAST, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS served
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (
  SELECT q.*, pass, (pass * source_size + served)::DOUBLE / weight AS finish FROM q, (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0),
r AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rk, pass, h, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS running FROM e),
c AS (SELECT k, count(*) AS copies FROM r WHERE running <= budget GROUP BY k)
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * coalesce(copies, 0))::BIGINT AS taken
FROM q LEFT JOIN c USING (k)
"""
