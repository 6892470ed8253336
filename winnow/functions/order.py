"""Seeded orders that any engine can reproduce: by md5 of a seed and an id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded(seed: int | str | Column, *ids: str | Column) -> Column:
    """The sort key of a row: md5 of the seed and the id parts, joined by colons."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", first.cast("string"), *((F.col(i) if isinstance(i, str) else i).cast("string") for i in ids)))


def uniform(seed: int | str, *ids: str | Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the sort key."""
    return (F.conv(F.substring(seeded(seed, *ids), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def content_key(backbone: str, paths: str | Column) -> Column:
    """The first 16 hex digits of SHA-1 over a name and the paths, NUL between them."""
    return F.substring(F.sha1(F.concat_ws("\x00", F.lit(backbone), F.col(paths) if isinstance(paths, str) else paths)), 1, 16)
