"""Manifests to training sets: label maps, flags, drop sets, leakage checks, path resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_of(value: Column, positive: str, normal: str) -> Column:
    """``1.0``: positive; ``0.0``: normal; anything else: null, to be dropped."""
    return F.when(value == "1.0", positive).when(value == "0.0", normal)


def label_or_normal(value: Column, positive: str, normal: str) -> Column:
    """``1.0``: positive; anything else, null too: normal."""
    return F.when(value == "1.0", positive).otherwise(normal)


def flag_of(value: Column, uncertain_is_device: bool = False) -> Column:
    """A labeler's flag as device, uncertain, no_device or unmentioned (blank or null)."""
    doubtful = "device" if uncertain_is_device else "uncertain"
    return F.when(value == "1.0", "device").when(value == "-1.0", doubtful).when(value == "0.0", "no_device").otherwise("unmentioned")


def last_flags(rows: DataFrame, keys: list[str], flag: str, order: str) -> DataFrame:
    """One flag a key: that of the last row."""
    return rows.groupBy(*keys).agg(F.max_by(flag, order).alias(flag))


def name_parts(path: Column) -> Column:
    """(subject, study, dicom) of a file name ``subject_study_dicom.ext``; missing parts are null."""
    stem = F.regexp_replace(F.element_at(F.split(path, "[/\\\\]"), -1), r"\.[^.]*$", "")
    part = lambda i: F.get(F.split(stem, "_"), F.lit(i))
    return F.struct(part(0).alias("subject"), part(1).alias("study"), part(2).alias("dicom"))


def drop_set(*signals: DataFrame, key: str) -> DataFrame:
    """The distinct keys of several exclusion signals; null keys are left out."""
    return reduce(lambda a, b: a.unionByName(b), (s.select(key) for s in signals)).where(F.col(key).isNotNull()).distinct()


def without(df: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key is not dropped; also what is left over from a chosen set."""
    return df.join(dropped.select(key), key, "left_anti")


def flag_report(records: DataFrame, flags: DataFrame, keys: list[str], cls: str, uncertain_is_device: bool = False) -> DataFrame:
    """(class, bucket, n, share of the class): records without a row in ``flags`` are ``unmatched``."""
    known = flags.select(*keys, "flag", F.lit(True).alias("_there"))
    bucket = F.when(F.col("_there").isNull(), "unmatched").otherwise(flag_of(F.col("flag"), uncertain_is_device))
    n = records.join(known, keys, "left").groupBy(cls, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    total = n.groupBy(F.col(cls).alias("_c")).agg(F.sum("n").alias("_t"))
    return n.join(total, F.col(cls).eqNullSafe(F.col("_c"))).select(cls, "bucket", "n", (F.col("n") / F.col("_t")).alias("share"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both have."""
    return a.select(key).intersect(b.select(key))


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """ValueError if a key is in both."""
    shared = overlap(a, b, key).where(F.col(key).isNotNull()).limit(3).collect()
    if shared:
        raise ValueError(f"both sets have {key} {', '.join(str(r[0]) for r in shared)}")


def split_counts(df: DataFrame, split: str, cls: str, subject: str) -> DataFrame:
    """(split, class, rows, distinct subjects)."""
    return df.groupBy(split, cls).agg(F.count("*").alias("n"), F.countDistinct(subject).alias("subjects"))


def resolve_paths(manifest: DataFrame, listing: DataFrame, roots: list[str], path: str = "relpath", prefix: str = "files/") -> DataFrame:
    """``manifest`` with ``found``: the first that is listed of root/path and root/path without ``prefix``, by root; null if none is."""
    spelled = F.array_distinct(F.array(F.col(path), F.when(F.col(path).startswith(prefix), F.substring(F.col(path), len(prefix) + 1, 1 << 20)).otherwise(F.col(path))))
    under = lambda root: F.transform(spelled, lambda p: F.concat(F.lit(root.rstrip("/") + "/"), p))
    tries = F.flatten(F.array(*(under(r) for r in roots)))
    options = manifest.select(path).where(F.col(path).isNotNull()).distinct().select(path, F.posexplode(tries).alias("_rank", "found"))
    best = options.join(listing.select(F.col("path").alias("found")).distinct(), "found").groupBy(path).agg(F.min_by("found", "_rank").alias("found"))
    return manifest.join(best, path, "left")


def missing_counts(resolved: DataFrame, cls: str) -> DataFrame:
    """(class, found, missing)."""
    return resolved.groupBy(cls).agg(F.count("found").alias("found"), F.count_if(F.col("found").isNull()).alias("missing"))


def optional_lookup(rows: DataFrame, lookup: DataFrame | None, key: str, columns: dict[str, str]) -> DataFrame:
    """``rows`` with ``columns`` (name: type) of a table that may not be there, or may not know a row; null then. Of repeated keys the smallest values count."""
    if lookup is None:
        return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items()})
    known = lookup.groupBy(key).agg(F.min(F.struct(*columns)).alias("_l"))
    return rows.drop(*columns).join(known, key, "left").withColumns({c: F.col(f"_l.{c}").cast(kind) for c, kind in columns.items()}).drop("_l")
