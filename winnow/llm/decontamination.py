"""Benchmark decontamination by q-gram filtering of diagonal bands and banded alignment.

Texts and items are compared as letters and digits, lower-cased, with one space for
each run of anything else. An item of m characters may differ from a region of a
text by up to e = ``RATE`` * m edits. By the q-gram lemma such a region shares at
least m - q + 1 - q * e of the item's q-grams with it, on diagonals that are at most
e apart. So the shared q-grams of each text are counted in diagonal bands of width
2w that overlap by half (w at least e): a band below the bound holds no match, and the others are
verified by an alignment in a band around them. Each item takes the largest q, from ``Q``
down to ``Q_LEAST``, that keeps its bound at ``LEAST`` or more, so that the tenth of edits holds for
all items of ``SHORT`` characters or more. Shorter ones match exactly, as whole words, looked up by a hash.

The benchmark is the query set. A block of it, of ``MAX_ITEMS`` items and ``MAX_CHARS``
characters about, is sent to all tasks as a q-gram index; more items make more blocks, each
a pass over the texts of which only the hits are kept, so that one block at a time
is held. Texts are neither shuffled nor cut; only hits leave the tasks.

Nulls: a null or empty text has no hits; items that are null or have no letters or
digits match nothing. Repeated items give a hit each, repeated rows too. The best
(fewest edits, then first) region of each (text, item) is reported; offsets count
characters of the original text. Empty tables give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm._common import fresh, materialise, table
from winnow.llm._text import data_of, slices

Q, Q_LEAST = 8, 4
RATE = 0.1
LEAST = 8
SHORT = Q_LEAST * (int(RATE * 15) + 1) + LEAST - 1  # 15
MAX_ITEMS, MAX_CHARS = 50_000, 8_000_000
PLACES = 1 << 21  # shared q-grams held at a time, about
_BITS = 22
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    """Code point to its lower-case form if it is a letter or digit, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_FOLDED: list[np.ndarray] = []


def folded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits, lower-cased, with a 0 for each run of others between them; and each one's place."""
    if not _FOLDED:
        _FOLDED.append(_classes())
    c = _FOLDED[0][codes]
    keep = c > 0
    keep[1:] |= c[:-1] > 0  # the first of a run
    at = np.flatnonzero(keep)
    return c[at], at


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def normal(text: str) -> np.ndarray:
    c, _ = folded(_codes(text))
    used = np.flatnonzero(c)
    return c[used[0] : used[-1] + 1] if len(used) else c[:0]


def _grams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of each run of q symbols."""
    h, width = c.astype(np.uint64) * _MUL + np.uint64(1), 1
    while width < q and len(h) > (step := min(width, q - width)):  # two runs of a width, which overlap in the last step
        h = (h[:-step] ^ (h[:-step] >> np.uint64(29))) * _MUL + h[step:]
        width += step
    return h if width >= q else h[:0]


@dataclass
class Item:
    id: int
    chars: np.ndarray
    edits: int
    q: int  #: 0: it matches exactly, as whole words
    least: int  #: shared q-grams that a match has

    @staticmethod
    def of(item_id: int, chars: np.ndarray) -> Item:
        m, edits = len(chars), int(RATE * len(chars))
        for q in range(Q, Q_LEAST - 1, -1) if m >= SHORT else ():
            if (least := m - q + 1 - q * edits) >= LEAST:
                return Item(item_id, chars, edits, q, least)
        return Item(item_id, chars, 0, 0, 0)


@dataclass
class Grams:
    """The q-grams of all items of one q."""

    q: int
    grams: np.ndarray  #: sorted distinct hashes
    begin: np.ndarray  #: of each hash: where its places in items begin
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray  #: by the top bits of a hash: whether any item has it
    reach: int  #: symbols of a text that a match covers at most

    @staticmethod
    def of(q: int, items: dict[int, Item]) -> Grams:
        each = {k: _grams(x.chars, q) for k, x in items.items()}
        g = np.concatenate(list(each.values()))
        which = np.repeat(np.array(list(each)), [len(v) for v in each.values()])
        place = np.concatenate([np.arange(len(v)) for v in each.values()])
        by = np.argsort(g, kind="stable")
        seen = np.zeros(1 << _BITS, bool)
        seen[(g * _MUL >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        distinct, begin = np.unique(g[by], return_index=True)
        return Grams(q, distinct, np.append(begin, len(g)), which[by], place[by], seen, max(len(x.chars) + x.edits for x in items.values()))


@dataclass
class Index:
    items: list[Item]
    grams: list[Grams]
    words: dict[int, tuple[np.ndarray, np.ndarray]]  #: by length of a short item: sorted hashes, and the items

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Index:
        items = [Item.of(item_id, c) for item_id, text in rows if len(c := normal(text or ""))]
        by_q: dict[int, dict[int, Item]] = {}
        by_length: dict[int, list[int]] = {}
        for k, x in enumerate(items):
            if x.q:
                by_q.setdefault(x.q, {})[k] = x
            else:
                by_length.setdefault(len(x.chars), []).append(k)
        words = {}
        for m, which in by_length.items():
            h = _grams(np.concatenate([items[k].chars for k in which]), m)[::m]
            by = np.argsort(h, kind="stable")
            words[m] = h[by], np.array(which)[by]
        return Index(items, [Grams.of(q, by_q[q]) for q in sorted(by_q)], words)


def align(item: np.ndarray, region: np.ndarray, edits: int, slack: int) -> tuple[int, int, int] | None:
    """The fewest edits that turn ``item`` into a part of ``region``, with that part's start and end; None if over ``edits``.

    Row i of the table holds the costs of the item's first i characters against parts
    that end in a band of ``slack`` + 2 * ``edits`` + 1 places from i - ``edits``.
    """
    width = slack + 2 * edits + 1
    lane = np.arange(width)
    far = 1 << 20
    padded = np.concatenate([np.zeros(edits, np.uint32), region, np.zeros(width + len(item), np.uint32)])
    end0 = lane - edits
    cost = np.where((end0 >= 0) & (end0 <= len(region)), 0, far)
    start = end0.copy()
    for i, ch in enumerate(item.tolist(), 1):
        ends = lane + i - edits  # the part's end, in region
        ok = (ends >= 0) & (ends <= len(region))
        sub = cost + (padded[i - 1 : i - 1 + width] != ch) + np.where(ends >= 1, 0, far)
        gone = np.concatenate([cost[1:] + 1, [far]])  # the item's character is missing in the region
        best = np.minimum(sub, gone)
        origin = np.where(sub <= gone, start, np.concatenate([start[1:], [0]]))
        best = np.where(ok, best, far)
        # extra characters of the region: the cheapest way from any lane before
        at = best - lane
        least = np.minimum.accumulate(at)
        came = np.maximum.accumulate(np.where(at == least, lane, 0))
        cost, start = np.where(ok, least + lane, far), origin[came]
        if cost.min() > edits:
            return None
    k = int(np.argmin(cost))
    return int(cost[k]), int(start[k]), int(k + len(item) - edits)


def find(index: Index, texts: pa.StringArray) -> list[list[tuple[int, int, int, int]]]:
    """For each text its hits (item id, first character, end, edits)."""
    hits: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(texts))]
    joined = data_of(texts).decode("utf-8")
    codes = _codes(joined)
    sizes = np.array([len(t) for t in texts.to_pylist()], np.int64)
    first = np.cumsum(sizes) - sizes
    if not len(codes) or not index.items:
        return hits
    c, at = folded(codes)
    edge = np.searchsorted(at, np.append(first, len(codes)))  # the texts' places among the kept symbols
    doc_of = np.repeat(np.arange(len(texts)), np.diff(edge))
    least = np.array([x.least for x in index.items])
    edits = np.array([x.edits for x in index.items])
    width = np.maximum(4, edits)
    for grams in index.grams:
        at_g, k = _shared(grams, c, doc_of)
        n = grams.begin[k + 1] - grams.begin[k]
        part = np.cumsum(n) // PLACES
        for i in np.flatnonzero(np.diff(part, prepend=-1)) if len(n) else []:
            # a match that ends in this part of the places has all its q-grams in here
            i0, i1 = np.searchsorted(at_g, at_g[i] - grams.reach), np.searchsorted(part, part[i], "right")
            for item, doc, diagonal in _bands(grams, at_g[i0:i1], k[i0:i1], n[i0:i1], doc_of, least, width, edits):
                _verify(index.items[item], doc, diagonal, 2 * int(width[item]), c, at, edge, first, hits)
    _exact(index, c, at, edge, doc_of, first, hits)
    return [_best(h) for h in hits]


def _shared(grams: Grams, c: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in ``c`` a q-gram of an item stands that doesn't go past its text, and which."""
    g = _grams(c, grams.q)
    at = np.flatnonzero(grams.seen[(g * _MUL >> np.uint64(64 - _BITS)).astype(np.int64)])
    at = at[doc_of[at] == doc_of[at + grams.q - 1]]
    k = np.minimum(np.searchsorted(grams.grams, g[at]), len(grams.grams) - 1)
    same = grams.grams[k] == g[at]
    return at[same], k[same]


def _bands(grams: Grams, at: np.ndarray, k: np.ndarray, n: np.ndarray, doc_of: np.ndarray, least: np.ndarray, width: np.ndarray, edits: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item, text, first diagonal) of the bands that reach an item's bound."""
    post = np.repeat(grams.begin[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    place = np.repeat(at, n)
    item, diagonal = grams.item[post], place - grams.place[post]
    doc = doc_of[place]
    # bands of 2 * width diagonals from a multiple of width: a half's count and the next half's
    band = diagonal // width[item]
    far = np.int64(len(doc_of) + 2)
    full = (doc * len(least) + item) * (2 * far) + band + far
    order = np.argsort(full, kind="stable")
    halves, begin, half = np.unique(full[order], return_index=True, return_counts=True)
    count = half.copy()
    count[:-1] += np.where(np.diff(halves) == 1, half[1:], 0)
    for i in np.flatnonzero(count >= least[item[order[begin]]]):
        o = order[begin[i] : begin[i] + count[i]]
        x = int(item[o[0]])
        w, low = int(width[x]), int(band[o[0]]) * int(width[x])
        # a match's q-grams lie on edits + 1 diagonals, the first of which is in this half
        upto = np.concatenate([[0], np.cumsum(np.bincount(diagonal[o] - low, minlength=2 * w))])
        if (upto[edits[x] + 1 : edits[x] + 1 + w] - upto[:w]).max() >= least[x]:
            yield x, int(doc[o[0]]), low


def _verify(x: Item, doc: int, diagonal: int, span: int, c: np.ndarray, at: np.ndarray, edge: np.ndarray, first: np.ndarray, hits: list) -> None:
    begin = max(int(edge[doc]), diagonal - x.edits)
    end = min(int(edge[doc + 1]), diagonal + span + len(x.chars) + x.edits)
    spot = _equal(c[begin:end], x.chars)
    if spot >= 0:  # no edits: nothing to align
        return _add(x, doc, begin + spot, begin + spot + len(x.chars), 0, at, first, hits)
    if any(h[0] == x.id and h[3] == 0 for h in hits[doc]):  # a match with edits can't be the best
        return None
    found = align(x.chars, c[begin:end], x.edits, min(end - begin, span + 2 * x.edits))
    if found:
        cost, a, b = found
        _add(x, doc, begin + a, begin + b, cost, at, first, hits)


def _equal(region: np.ndarray, item: np.ndarray) -> int:
    """The first place where ``item`` stands in ``region``, or -1."""
    a, b, at = region.tobytes(), item.tobytes(), -1
    while True:
        at = a.find(b, at + 1)
        if at < 0 or at % 4 == 0:
            return at // 4 if at >= 0 else -1


def _add(x: Item, doc: int, a: int, b: int, cost: int, at: np.ndarray, first: np.ndarray, hits: list) -> None:
    if b > a:
        hits[doc].append((x.id, int(at[a] - first[doc]), int(at[b - 1] - first[doc]) + 1, cost))


def _exact(index: Index, c: np.ndarray, at: np.ndarray, edge: np.ndarray, doc_of: np.ndarray, first: np.ndarray, hits: list) -> None:
    """Items too short for q-grams: runs of whole words, by their hash, that are equal to one."""
    if not index.words:
        return
    opens, ends = np.zeros((2, len(c) + 1), bool)  # before a place: a gap or a text's edge; at a place: the same
    opens[edge], ends[edge] = True, True
    opens[1:] |= c == 0
    ends[:-1] |= c == 0
    begins = np.flatnonzero(opens[:-1] & (c > 0))
    for m, (known, which) in index.words.items():
        spots = begins[begins + m <= len(c)]
        spots = spots[ends[spots + m]]
        spots = spots[doc_of[spots] == doc_of[spots + m - 1]]
        h = _grams(c, m)[spots]
        lo, hi = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
        some = np.flatnonzero(hi > lo)
        # the first place in each text is the one reported
        once = some[np.sort(np.unique(doc_of[spots[some]] * np.int64(len(known)) + lo[some], return_index=True)[1])]
        for j in once.tolist():
            a = int(spots[j])
            for k in which[lo[j] : hi[j]].tolist():
                x = index.items[k]
                if (c[a : a + m] == x.chars).all():
                    _add(x, int(doc_of[a]), a, a + m, 0, at, first, hits)


def _best(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    best: dict[int, tuple[int, int, int, int]] = {}
    for h in sorted(found, key=lambda h: (h[3], h[1], h[2])):
        best.setdefault(h[0], h)
    return [best[k] for k in sorted(best)]


HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.LongType())]))


def hits_udf(index):
    """A UDF from texts to their hits; ``index``: a broadcast."""

    @F.arrow_udf(HITS)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([(f, pa.int64()) for f in ("item_id", "start", "end", "edits")]))
        for texts in batches:
            rows = [h for part in slices(texts, 1 << 20) for h in find(index.value, part)]
            yield pa.array([[dict(zip(("item_id", "start", "end", "edits"), x)) for x in h] for h in rows], kind)

    return hits


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).where("t is not null")
    n = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("c")).first()
    blocks = max(1, -(-n["n"] // MAX_ITEMS), -(-n["c"] // MAX_CHARS))
    return [items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else items for k in range(blocks)]


def _sent(block: DataFrame):
    return block.sparkSession.sparkContext.broadcast(Index.of([tuple(r) for r in block.orderBy("i", "t").collect()]))


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "hits") -> DataFrame:
    """``docs`` with an array of hits (item_id, start, end, edits) in ``out``, which replaces a column of that name."""
    docs, blocks = docs.drop(out), _blocks(benchmark)
    if len(blocks) == 1:
        return docs.withColumn(out, hits_udf(_sent(blocks[0]))(text))
    row, of = fresh(docs, "row", "of")
    docs, found = materialise(docs.withColumn(row, F.monotonically_increasing_id())), []
    for block in blocks:
        index = _sent(block)
        found.append(materialise(docs.select(F.col(row).alias(of), hits_udf(index)(text).alias(out)).where(F.size(out) > 0)))
        index.destroy()
    hits = reduce(DataFrame.unionByName, found).groupBy(of).agg(F.sort_array(F.flatten(F.collect_list(out))).alias(out))
    return docs.join(hits, F.col(row) == F.col(of), "left").withColumn(out, F.coalesce(out, F.array().cast(HITS))).drop(row, of)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has no hit; columns as before."""
    blocks = _blocks(benchmark)
    for k, block in enumerate(blocks):
        index = _sent(block)
        docs = docs.where(F.size(hits_udf(index)(text)) == 0)
        if k < len(blocks) - 1:  # what a block leaves is the next one's input
            docs = materialise(docs)
            index.destroy()
    return docs


def op2_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it contains, whole documents against all items."""
    docs = with_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
