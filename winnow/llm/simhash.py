"""SimHash near-duplicates, found with pivot distance tables.

A text's fingerprint has a bit set if over half of its shingle hashes have it
set. Fingerprints within ``bits`` differing bits are linked; documents in one
component of the links are one group.

Distances to reference fingerprints (pivots) are computed once per distinct
fingerprint. By the triangle inequality two fingerprints within k bits differ by
at most k in every coordinate, so a pair with a larger coordinate difference is
discarded and only the rest is verified. To get at pairs without comparing all, the
pivots come in blocks that see disjoint parts of the 64 bits: k differing bits
leave one of k + 1 parts untouched, and inside the rest one of k + 1 again, so
the pair agrees in all coordinates of these two blocks. Fingerprints meet on such equal
coordinates (an equi-join with about 35 bits of key), never in a cross join.
Distinct fingerprints only take part: copies cost one row.

Nulls and texts without words have fingerprint 0 and are linked like any other.
A null id keeps its row and takes the component of its fingerprint; a component
of null ids only has a null id. Repeated rows come out as often as they went in.
Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm._common import discard, fresh, join_by_key, materialise, row_hash, table
from winnow.llm._text import LOWER, data_of, offsets_of, slices
from winnow.llm.components import connected_components
from winnow.llm.jaccard_join import near_copy_groups
from winnow.llm.near_copies import SHINGLE as WIDE
from winnow.llm.near_copies import in_slots, slots_of

SHINGLE = 3
BITS = 2
SEED = 42
CHUNK = 1 << 16


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """The fingerprint of one text, its bytes A-Z lower-cased already."""
    words = text.split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - n + 1)
    digest, over = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, k, CHUNK):
        upto = min(k, at + CHUNK)
        last = ends[at + n - 1 : upto + n - 1] if len(words) >= n else ends[-1:]
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:upto].tolist(), last.tolist())], np.uint64)
        over += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * over > k, bitorder="little").tobytes(), "little")


def simhash64(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprints as signed longs."""

    @F.arrow_udf(T.LongType())
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for part in slices(texts):
                data, off = data_of(part).translate(LOWER), offsets_of(part)
                off = (off - off[0]).tolist()
                out += [fingerprint(data[a:b], shingle) for a, b in zip(off, off[1:])]
            yield pa.array(np.array(out, np.uint64).view(np.int64))

    return prints(text)


def pivots(width: int, shift: int, seed: int, references: int = 11) -> list[int]:
    """Reference fingerprints for one part of the bits: the empty one and seeded ones."""
    rng = np.random.default_rng(seed)
    most = (1 << width) - 1
    return [x << shift for x in [0, *(int(r) & most for r in rng.integers(0, 1 << 62, references))]]


def bits_of(x: int) -> Column:
    """64 bits as a long."""
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def distance(fp: Column, other: int | Column, mask: int = -1) -> Column:
    """Differing bits, within ``mask``."""
    x = fp.bitwiseXOR(bits_of(other) if isinstance(other, int) else other)
    return F.bit_count(x if mask == -1 else x.bitwiseAND(bits_of(mask)))


def parts(shift: int, width: int, n: int) -> list[tuple[int, int]]:
    """``n`` runs of bits (shift, width) that make up one."""
    edges = [shift + width * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def linked_fingerprints(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """From distinct (fp) to the links (fp, other) with ``fp < other`` and at most ``bits`` differing bits.

    Pivots are arrays that functions go through: with an expression for each, the driver's plan was twice as large and all of it became code.
    """
    n = bits + 1
    whole = pivots(64, 0, 1, 8)
    outer = parts(0, 64, n)
    # a list of distances for each part, and for the n parts of each part
    lists = {(i, None): _distances(*p) for i, p in enumerate(outer)} | {(i, j): _distances(*q) for i, p in enumerate(outer) for j, q in enumerate(parts(*p, n))}
    rows = fps.select("fp", F.transform(F.array(*map(bits_of, whole)), lambda p: distance(F.col("fp"), p).cast("tinyint")).alias("d"), *(c.alias(f"t{i}_{j}") for (i, j), c in lists.items()))
    keys = [F.xxhash64(F.lit(i * n + j), f"t{i}_None", *(f"t{o}_{j}" for o in range(n) if o != i)) for i in range(n) for j in range(n)]
    rows = rows.select("fp", "d", F.explode(F.array(*keys)).alias("key"))
    a = rows.select("key", F.col("fp").alias("a"), F.col("d").alias("da"))
    b = rows.select("key", F.col("fp").alias("b"), F.col("d").alias("db"))
    apart = F.greatest(*(F.abs(F.col("da")[k] - F.col("db")[k]) for k in range(len(whole))))
    pairs = a.join(b, (a.key == b.key) & (F.col("a") < F.col("b")) & (apart <= bits) & (distance(F.col("a"), F.col("b")) <= bits))
    return pairs.select(F.col("a").alias("fp"), F.col("b").alias("other"))


def _distances(shift: int, width: int) -> Column:
    """The distances of a part's bits to its pivots, five bits each, in one long: equal for equal bits."""
    mask = ((1 << width) - 1) << shift
    own = F.array(*map(bits_of, pivots(width, shift, shift)))
    return F.aggregate(own, F.lit(0).cast("long"), lambda out, p: F.shiftleft(out, 5).bitwiseOR(distance(F.col("fp"), p, mask).cast("long")))


def simhash_groups(df: DataFrame, id_col: str, text_col: str, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long, component) for each row of ``df``; component: the smallest id of the row's group."""
    prints = materialise(df.select(F.col(id_col).alias("id"), simhash64(F.col(text_col), shingle).alias("fp")))
    nodes = materialise(prints.groupBy("fp").agg(F.min("id").alias("least")))
    links = linked_fingerprints(nodes.select("fp"), bits)
    comps = connected_components(links.select(F.col("fp").alias("a"), F.col("other").alias("b")))
    # the smallest id over a component of fingerprints; those without links are their own
    linked = materialise(comps.select(F.col("node").alias("fp"), F.col("component").alias("c")).join(nodes, "fp"))
    least = linked.groupBy("c").agg(F.min("least").alias("component"))
    named = linked.join(least, "c").select("fp", "component")
    named = materialise(nodes.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component")))
    return join_by_key(prints, named, "fp").select("id", "fp", "component")


def near_texts(texts: DataFrame, bits: int = BITS, shingle: int = WIDE) -> DataFrame:
    """(a, b): pairs of ``texts`` (t, text), written, whose fingerprints are equal or linked.

    A fingerprint is named by the smallest t that has it; the others are paired with that one only, so copies cost a row each.
    """
    prints = materialise(texts.select("t", simhash64(F.col("text"), shingle).alias("fp")).distinct())
    firsts = materialise(prints.groupBy("fp").agg(F.min("t").alias("first")))
    equal = join_by_key(prints, firsts, "fp").where("t != first").select(F.col("first").alias("a"), F.col("t").alias("b"))
    links = linked_fingerprints(firsts.select("fp"), bits)
    near = links.join(firsts.toDF("fp", "a"), "fp").join(firsts.toDF("other", "b"), "other").select("a", "b")
    out = materialise(equal.unionByName(near).distinct())
    for done in (prints, firsts):
        discard(done)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies of ``docs`` (doc_id, text): the one with the smallest doc_id, null last, then text hash, then the hash of all its columns; columns as before.

    Texts with near fingerprints are compared by their shingles first (:func:`near_texts`); what is similar and further apart than that is
    found from there by :mod:`jaccard_join`. Of rows that are equal in all columns one stays. A row that is alone in its group
    stays where it is; only rows of larger groups, and few others that share their slots, are shuffled with all their columns.
    """
    (keep,) = fresh(docs, "keep")
    names = fresh(docs, *(f"{keep}_{f}" for f in ("none", "id", "hash", "tie")))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), row_hash(docs).alias("tie"))
    groups = materialise(near_copy_groups(docs.select(key.alias("key"), "text"), candidates=near_texts))
    by = groups.groupBy("group").agg(F.min("key").alias("id"), F.count("*").alias("rows"))
    copied = groups.join(by.where("rows > 1").select("group"), "group", "left_semi").select(F.xxhash64("key.*").alias("v"))
    kept = by.select("id.*").toDF(*names)
    keyed = docs.withColumn(keep, key).withColumns({c: F.col(f"{keep}.{f}") for c, f in zip(names, ("none", "id", "hash", "tie"))}).drop(keep)
    copy = in_slots(slots_of(copied))(F.xxhash64(*names))
    some = keyed.where(copy).join(kept, names, "left_semi").dropDuplicates(names)
    return keyed.where(~copy).drop(*names).union(some.drop(*names))


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    groups = simhash_groups(table(spark, sf_dir, "documents"), "doc_id", "text")
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
