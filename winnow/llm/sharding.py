"""Reproducible shuffle and sharding: a Feistel permutation of row numbers.

Rows get global numbers 0..N-1 in the order of their keys. A Feistel network on
the a x b grid (a = ceil(sqrt N), b = ceil(N / a)) permutes the numbers; a value
past N-1 walks on along its cycle until it falls below N. Position p of the
shuffle is slot ``p div shards`` of shard ``p mod shards``: shard sizes differ by
one at most, slots have no gaps, and a reader can compute the row of any
(shard, slot) by the inverse without a table.

Nulls: a null key is numbered last. Rows equal in the key are ordered by a hash
of the whole row; rows equal in all columns are interchangeable. Empty input
gives no rows. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.llm._common import fresh, materialise, row_hash, small, table

ROUNDS = 3  # pairs of half-rounds
WALK = 32  # at most a - 1 <= WALK values lie past N for N <= 1,000; beyond, each step leaves the range with odds under 1/b


def global_row_numbers(df: DataFrame, order_by: list[str], name: str = "row_number") -> tuple[DataFrame, str]:
    """``df`` with 0-based row numbers in the order of ``order_by``, nulls last, and the name of a column with the row count.

    One range shuffle; within a partition the place comes from the sort, and the
    offsets are a running sum over one row per partition. No row passes a single task.
    """
    df = df.drop(name)
    tie, scan, pos, part, first, total = fresh(df, "tie", "scan", "pos", "part", "first", "total")
    keys = [F.col(c).asc_nulls_last() for c in order_by] + [F.col(tie), F.col(scan)]
    staged = df.withColumn(tie, row_hash(df)).withColumn(scan, F.monotonically_increasing_id())
    staged = staged.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie, scan)
    # written once: a second evaluation could sample other range bounds
    staged = materialise(staged.withColumn(pos, F.monotonically_increasing_id()))
    parts = staged.groupBy(F.shiftright(pos, 33).alias(part)).agg(F.count("*").alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(first), F.sum("_n").over(Window.partitionBy()).alias(total))
    out = staged.withColumn(part, F.shiftright(pos, 33)).join(small(parts), part)
    return out.withColumn(name, F.col(first) + F.col(pos).bitwiseAND((1 << 33) - 1)).drop(part, pos, first), total


def _mix(seed: int, step: int, value: Column) -> Column:
    """60 bits of the MD5 of ``seed:step:value``, which other engines can compute too."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{step}:"), value.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _grid(n: Column) -> tuple[Column, Column]:
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long"))
    return a, F.greatest(F.floor((n + a - 1) / a).cast("long"), F.lit(1).cast("long"))


def _once(x: Column, a: Column, b: Column, seed: int, inverse: bool) -> Column:
    left, right = F.floor(x / b).cast("long"), x % b
    for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        if inverse:
            right = F.pmod(right - _mix(seed, 2 * i + 1, left) % b, b)
            left = F.pmod(left - _mix(seed, 2 * i, right) % a, a)
        else:
            left = (left + _mix(seed, 2 * i, right) % a) % a
            right = (right + _mix(seed, 2 * i + 1, left) % b) % b
    return left * b + right


def feistel(x: Column, n: Column, seed: int = 0, inverse: bool = False) -> Column:
    """The place of row number ``x`` in a seeded shuffle of ``n`` rows, or the row number at place ``x``."""
    a, b = _grid(n)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _once(x, a, b, seed, inverse), lambda p, _: F.when(p < n, p).otherwise(_once(p, a, b, seed, inverse)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the cycle walk did not end")).cast("long"))


def shard(df: DataFrame, order_by: list[str], shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    df = df.drop("shard", "slot")
    at, place = fresh(df, "row_number", "place")
    numbered, total = global_row_numbers(df, order_by, at)
    placed = numbered.withColumn(place, feistel(F.col(at), F.col(total), seed))
    return placed.withColumn("shard", (F.col(place) % shards).cast("int")).withColumn("slot", F.floor(F.col(place) / shards).cast("long")).drop(at, place, total)


def row_at(spark: SparkSession, shard: int, slot: int, shards: int, n: int, seed: int = 0) -> int:
    """The global row number that lies in a slot of a shard."""
    x = F.lit(slot * shards + shard).cast("long")
    return spark.range(1).select(feistel(x, F.lit(n).cast("long"), seed, inverse=True).alias("r")).first()["r"]


def grid(n: int) -> tuple[int, int]:
    """The grid's sides, as the columns above compute them."""
    a = max(1, isqrt(n) + (isqrt(n) ** 2 < n))
    return a, max(1, -(-n // a))


def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards; law ``rows``."""
    text = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"))
    return shard(docs, ["doc_id"], 16, seed=1).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _half_rounds(seed: int, place: str) -> str:
    """SQL columns l, r of each half-round, from ``place`` to ``q``."""
    mix = lambda step, v: f"('0x' || substr(md5('{seed}:{step}:' || {v}), 1, 15))::BIGINT"
    out = [f"{place} // b AS l0", f"{place} % b AS r0"]
    for i in range(ROUNDS):
        out += [f"(l{i} + {mix(2 * i, f'r{i}')} % a) % a AS l{i + 1}", f"(r{i} + {mix(2 * i + 1, f'l{i + 1}')} % b) % b AS r{i + 1}"]
    return ", ".join([*out, f"l{ROUNDS} * b + r{ROUNDS} AS q"])


OP1_SQL = f"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab),
d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + 1 AS size, row_number() OVER (ORDER BY doc_id NULLS LAST) - 1 AS x, count(*) OVER () AS n,
         xor(list_reduce([('0x' || h)::BIGINT for h in regexp_extract_all(hex(coalesce(text, '')), '..')], lambda c, h: xor(c >> 8, tab[(xor(c, h) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM documents, t),
g AS (SELECT x, n, ceil(sqrt(n))::BIGINT AS a, (n + ceil(sqrt(n))::BIGINT - 1) // ceil(sqrt(n))::BIGINT AS b FROM d),
w AS (
  SELECT x, n, a, b, q FROM (SELECT *, {_half_rounds(1, "x")} FROM g)
  UNION ALL SELECT x, n, a, b, q FROM (SELECT *, {_half_rounds(1, "p")} FROM (SELECT x, n, a, b, q AS p FROM w WHERE q >= n)))
SELECT doc_id, size, text_crc32, 'rows' AS law, (q % 16)::INT AS shard, q // 16 AS slot, NULL::INT AS grown_shard
FROM w JOIN d USING (x) WHERE q < w.n
"""
