"""Shingle sets of texts and what the joins on them share: hashes, the order of shingles, filters.

Words are split at space and \x09-\x0D, A-Z lower-cased. A text of fewer words than a
shingle is one shingle. Two texts are similar by the Jaccard similarity of their sets of shingles. In
any fixed order of all shingles, two texts of similarity p/q share a shingle among the first
``n - ceil(n p / q) + 1`` of each (n: shingles of the text), its prefix. Shingles that a sample of the texts has
often come last in the order. The sample decides what a join costs, not what it finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm._common import discard, materialise
from winnow.llm._text import LOWER, data_of, encoded, offsets_of, slices, translated, words_of
from winnow.llm.charlm import _C, _P, _mix

SHINGLE = 5
SIMILAR = (4, 5)
SAMPLE = 16  # one text in so many is looked at for common shingles
COMMON = 200_000
SLOTS = 1 << 24
LAST = np.uint64(1 << 63)
SLICE = 1 << 19  # bytes of text shingled at a time, if texts aren't longer
BITS = 512  # of a parity signature


def word_hashes(words: pa.StringArray) -> np.ndarray:
    """A hash of each word: a polynomial of its bytes, and its length."""
    if not len(words):
        return np.zeros(0, np.uint64)
    raw, off = np.frombuffer(data_of(words), np.uint8), offsets_of(words)
    off = off - off[0]
    tab = _mix(np.arange(1, 257, dtype=np.uint64) * _C)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(raw), _P)]))
    back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(raw), np.uint64(pow(int(_P), -1, 1 << 64)))]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tab[raw] * back[:-1])])
    return _mix((total[off[1:]] - total[off[:-1]]) * power[off[:-1]] + np.diff(off).astype(np.uint64) * _C)


def shingles(texts: pa.StringArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (63 bits) of the shingles of all texts, and the text of each."""
    words, off = words_of(translated(texts, LOWER))
    distinct, ids = encoded(words)
    h, count = word_hashes(distinct)[ids], np.diff(off)
    n = np.where(count > 0, np.maximum(1, count - size + 1), 0)
    doc = np.repeat(np.arange(len(count)), n)
    start = off[:-1][doc] + np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
    out = np.zeros(len(doc), np.uint64)
    for j in range(size):
        inside = start + j < off[1:][doc]
        out[inside] = _mix(out[inside] * _P + h[(start + j)[inside]] + np.uint64(1))
    return out >> np.uint64(1), doc


def distinct_sorted(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, the text of each, and how many each text has."""
    by = np.lexsort((h, doc))
    h, doc = h[by], doc[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new], np.bincount(doc[new], minlength=docs)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def whole_sets(size: int):
    """A UDF from a text to its shingles' hashes. It returns a slice at a time, as a batch's sets are larger than its texts."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in slices(texts, SLICE):
                h, doc = shingles(part, size)
                h, _, n = distinct_sorted(h, doc, len(part))
                yield _lists(h, n)

    return sets


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of ``values``; an empty run has 0."""
    out, full = np.zeros(len(sizes), np.uint64), sizes > 0
    if len(values):
        out[full] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[full])
    return out


def parities(h: np.ndarray, doc: np.ndarray, docs: int) -> pa.ListArray:
    """For each text ``BITS`` bits: whether an odd number of its shingles falls on each.

    A shingle that only one of two texts has flips one bit, so two signatures differ in as many bits at most as the sets have shingles apart.
    """
    at = doc * BITS + (h % np.uint64(BITS)).astype(np.int64)
    odd = (np.bincount(at, minlength=docs * BITS) & 1).astype(bool)
    return _lists(np.packbits(odd.reshape(docs, BITS), axis=1).reshape(-1).view(np.uint64), np.full(docs, BITS // 64))


def signatures(texts: DataFrame, size: int, similar: tuple[int, int], common) -> DataFrame:
    """(t, n, s, g, bits, prefix) from (t, text): a text's number of shingles, hashes of the whole set and of size and prefix, parities of the set, and the prefix in order.

    A row for each text, but for copies side by side. This is the one pass that shingles all texts.
    """
    p, q = similar

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = common.value
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), SLICE):
                t = np.asarray(batch.column(0).slice(at, len(part))).astype(np.int64)
                at += len(part)
                _, first = np.unique(t, return_index=True)  # copies side by side count once
                t, part = t[np.sort(first)], part.take(pa.array(np.sort(first)))
                h, doc = shingles(part, size)
                if len(known):
                    k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = np.where(known[k] == h, LAST + rank[k], h)
                h, doc, n = distinct_sorted(h, doc, len(part))
                length = np.where(n > 0, n - -(-p * n // q) + 1, 0)
                whole = _mix(_sums(_mix(h * _C + _P), n) + n.astype(np.uint64) * _C)
                keep = np.arange(len(h)) - (np.cumsum(n) - n)[doc] < length[doc]
                group = _mix(_sums(_mix(h[keep] * _P + _C), length) + n.astype(np.uint64) * _P)
                columns = [pa.array(t), pa.array(n.astype(np.int32)), pa.array(whole.view(np.int64)), pa.array(group.view(np.int64)), parities(h, doc, len(part)), _lists(h[keep], length)]
                yield pa.RecordBatch.from_arrays(columns, ["t", "n", "s", "g", "bits", "prefix"])

    return texts.select("t", "text").mapInArrow(found, "t long, n int, s long, g long, bits array<long>, prefix array<long>")


def common_shingles(docs: DataFrame, size: int, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most texts of a sample have, ascending, and their places from the rarest to the most common."""
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select(F.explode(whole_sets(size)("text")).alias("h"))
    counts = sample.groupBy("h").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.col("n").desc(), "h").limit(most).toArrow()
    h = np.asarray(counts["h"]).astype(np.uint64)
    rank = np.arange(len(h), 0, -1).astype(np.uint64)
    by = np.argsort(h)
    return h[by], rank[by]


def _enough(shared: Column, a: Column, b: Column, similar: tuple[int, int]) -> Column:
    """Whether ``shared`` of ``a`` and ``b`` shingles make the similarity, in whole numbers."""
    p, q = similar
    return F.lit(p + q) * shared >= F.lit(p) * (a + b)


def slots_of(values: DataFrame):
    """A broadcast of ``SLOTS`` bits, set where a slot has one of ``values`` (v): it spares work on the rest, a join decides."""
    slots = values.select(F.pmod(F.col("v"), F.lit(SLOTS)).cast("int").alias("slot")).distinct().toArrow()
    bits = np.zeros(SLOTS, bool)
    bits[np.asarray(slots["slot"])] = True
    return values.sparkSession.sparkContext.broadcast(np.packbits(bits))


def in_slots(sent):
    """A UDF that is true of all numbers whose slots :func:`slots_of` has sent and of few others."""

    @F.arrow_udf(T.BooleanType())
    def member(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in batches:
            at = np.asarray(v).astype(np.int64) % SLOTS
            yield pa.array((sent.value[at >> 3] >> (7 - (at & 7))) & 1 == 1)

    return member


def among(ids: DataFrame):
    """A UDF that is true of all numbers in ``ids`` (t) and of few others."""
    return in_slots(slots_of(ids.select(F.col("t").alias("v"))))


def close(pairs: DataFrame, nodes: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` (a, b) that sizes and parities of ``nodes`` (node, n, bits) leave: bits that differ are shingles that are not shared."""
    p, q = similar
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits"))
    apart = F.aggregate(F.zip_with("a_bits", "b_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = F.col("a_n") + F.col("b_n")
    return pairs.join(of("a"), "a").join(of("b"), "b").where(F.lit(p + q) * (both - apart) >= F.lit(2 * p) * both).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, size: int, similar: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` (a, b), written, whose ``texts`` (t, text) are similar enough, by their whole sets. Texts of no pair aren't shingled."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct()
    some = texts.where(among(wanted)("t")).groupBy("t").agg(F.first("text").alias("text"))
    sets = materialise(some.select("t", whole_sets(size)("text").alias("x")))
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    out = materialise(both.where(_enough(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), similar)).select("a", "b"))
    discard(sets)
    return out


def _sizes(a: str, b: str, similar: tuple[int, int]) -> Column:
    p, q = similar
    n = lambda x: F.col(f"{x}.n")
    return F.lit(q) * F.least(n(a), n(b)) >= F.lit(p) * F.greatest(n(a), n(b))


def _may(a: str, b: str, similar: tuple[int, int]) -> Column:
    """Whether two texts with a shingle in common, of sizes n and with it at places pos, can be similar enough if it is their first."""
    n, pos = lambda x: F.col(f"{x}.n"), lambda x: F.col(f"{x}.pos")
    return _sizes(a, b, similar) & _enough(F.least(n(a) - pos(a), n(b) - pos(b)), n(a), n(b), similar)


def _many(shared: Column, a: Column, b: Column, similar: tuple[int, int]) -> Column:
    """Whether texts of ``a`` and ``b`` shingles can be similar enough, if ``shared`` of those that they are compared by are common.

    What one of them has past these comes to ceil(0.8 n) - 1 at most; up to where the first of both lists ends, every common shingle is in both.
    """
    p, q = similar
    past = F.ceil(F.lit(p) * F.greatest(a, b) / F.lit(q)) - 1
    return _enough(shared + past, a, b, similar)
