"""Small tables with the cases that operators must stand: nulls, empty and long texts, ties, repeats, clashing names."""

import random

WORDS = "the of and ring tion ther hand stone water light river south north grain".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "er"]) for _ in range(n))


def documents(spark, rows=None, extra=False):
    """Documents, with columns named like outputs and internals if ``extra``."""
    if rows is None:
        rows = [(i, prose(i, 30 + i), ("en", "de")[i % 2], f"s{i % 4}", 100 + i) for i in range(40)]
        rows += [
            (100, None, "en", "s0", None), (101, "", None, None, 0), (102, " \t\n", "en", "s1", 3), (103, prose(3, 33), "en", None, 7),
            (104, prose(5, 20_000), "en", "s0", 9), (None, prose(9, 40), "fr", "s2", 1), (105, prose(5, 35), "de", "s3", 5), (105, prose(5, 35), "de", "s3", 5),
        ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        for name in ("shard", "slot", "score", "hits", "copies", "target", "source_size", "words", "row", "tie", "key", "fp", "component", "found", "features", "bucket", "part", "pos", "n", "id"):
            df = df.withColumn(name, F.lit(f"own {name}"))
    return df


def empty(spark):
    return documents(spark, [])


LABELS = "doc_id long, quality int, toxic int"
