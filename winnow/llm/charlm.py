"""Modified Kneser-Ney n-gram models over the characters of whole texts, counted by Spark.

A text is its words with one space between them, or one newline where the gap holds a
line end, with a start and an end. The window of a symbol is the symbol with up to
``order - 1`` before it: it reaches over words, never over texts.

Tasks count the distinct windows of their texts; everything after is made of Spark
aggregations and joins over n-grams (a row for each distinct one, keyed by n-grams, contexts
or suffixes, of which none has more rows than there are symbols): :func:`levels` counts
all orders, :func:`log_probabilities` gives each window of a second table its
interpolated probability. No order is cut and nothing is left out, so the tables grow
with the corpus. Windows with their values are then looked up from sorted hash arrays,
:func:`with_values`: sent to all tasks if they are at most ``BROADCAST_ROWS``, else
texts are dealt in chunks of ``CHUNK_BYTES`` and each chunk meets only the values of its
own windows. Both give the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm._common import fresh, materialise, small
from winnow.llm._text import data_of, slices

BOS, EOS, OTHER = "\x02", "\x03", "�"
UNSEEN = 1 / (1 << 17)  # of a character that the model hasn't met: one in all code points, about
BROADCAST_ROWS = 4_000_000  # 48 MB of hashes and values
CHUNK_BYTES = 32 << 20
SLICE = 1 << 18  # bytes of text handled at a time, if texts aren't longer
BLOCK = 1 << 18  # symbols hashed at a time, whatever the length of a text
HELD = 1 << 18  # windows that a counting task holds before it adds up equal ones; if over three quarters are left, it hands them on
_P, _A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def symbols(texts: pa.StringArray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each with a start and an end, and where each text begins, with the end of the last. ``fold``: in lower case."""
    framed = pc.binary_join_element_wise(BOS, pc.utf8_lower(texts) if fold else texts, EOS, "")
    edge = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(framed)).astype(np.int64))])
    s = np.frombuffer(data_of(framed).decode("utf-8").encode("utf-32-le"), np.uint32).copy()
    s[(s <= 3) & (s != 1)] = ord(OTHER)
    s[edge[:-1]], s[edge[1:] - 1] = ord(BOS), ord(EOS)
    space = (s == 32) | ((s >= 9) & (s <= 13))
    step = np.diff(space.view(np.int8), prepend=np.int8(0))
    a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)  # runs, and what follows each
    if not len(a):
        return s, edge
    line = np.add.reduceat(s == 10, a, dtype=np.int64) > 0  # what lies between two runs has no line end
    s[a] = np.where(line, 10, 32)
    # runs at the start or end of a text go; the frames are the only such code points
    keep = ~space
    keep[a[(s[a - 1] != ord(BOS)) & (s[b] != ord(EOS))]] = True
    gone = np.flatnonzero(~keep)
    return s[keep], edge - np.searchsorted(gone, edge)


def window_keys(s: np.ndarray, edge: np.ndarray, order: int, groups: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys and lengths of the windows of the symbols ``begin`` to ``end``; a text's start has length 1 and is no window."""
    low = max(0, begin - order + 1)
    m = _mix(s[low:end].astype(np.uint64) + np.uint64(1))
    length = np.full(end - begin, order, np.int8)
    near = np.flatnonzero((edge[:-1] > begin - order) & (edge[:-1] < end))
    first, stop = edge[near], edge[near + 1]
    h, short = m, []
    for k in range(1, order + 1):
        if k > 1:
            nxt = m.copy()
            nxt[1:] += h[:-1] * _P
            h = nxt
        if k < order:
            at = first + k - 1
            at = at[(at < stop) & (at >= begin) & (at < end)] - begin
            length[at] = k
            short.append((at, h[at + begin - low] + np.full(1, k, np.uint64) * _C))
    out = h[begin - low :] + np.full(1, order, np.uint64) * _C
    for at, keys in short:
        out[at] = keys
    if len(groups) and (groups == groups[0]).all():
        out += (groups[:1].astype(np.uint64) + np.uint64(1)) * _P
    else:
        out += (groups[texts_at(edge, begin, end)].astype(np.uint64) + np.uint64(1)) * _P
    return out, length


def texts_at(edge: np.ndarray, begin: int, end: int) -> np.ndarray:
    """The text of each symbol from ``begin`` to ``end``."""
    some = np.arange(np.searchsorted(edge, begin, "right") - 1, np.searchsorted(edge, end, "left"))
    return np.repeat(some, np.minimum(edge[some + 1], end) - np.maximum(edge[some], begin))


def gram_keys(grams: pa.StringArray, groups: np.ndarray) -> np.ndarray:
    """The keys of n-grams given as strings."""
    codes = np.frombuffer(data_of(grams).decode("utf-8").encode("utf-32-le"), np.uint32)
    sizes = np.asarray(pc.utf8_length(grams)).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    m, h = _mix(codes.astype(np.uint64) + np.uint64(1)), np.zeros(len(grams), np.uint64)
    for j in range(int(sizes.max(initial=0))):
        on = sizes > j
        h[on] = h[on] * _P + m[begin[on] + j]
    return h + sizes.astype(np.uint64) * _C + (groups.astype(np.uint64) + np.uint64(1)) * _P


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(keys, counts, groups, code points) with equal keys added."""
    keys, n, g, codes = (np.concatenate(x) for x in zip(*parts))
    by = np.argsort(keys)
    new = np.flatnonzero(np.diff(keys[by], prepend=keys[by][:1] + np.uint64(1))) if len(by) else by
    return keys[by[new]], np.add.reduceat(n[by], new) if len(new) else n, g[by[new]], codes[by[new]]


def _windows(part: pa.StringArray, groups: np.ndarray, order: int, fold: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(keys, counts, groups, code points) of the distinct windows of some texts, by block."""
    s, edge = symbols(part, fold)
    for begin in range(0, len(s), BLOCK):
        end = min(begin + BLOCK, len(s))
        keys, length = window_keys(s, edge, order, groups, begin, end)
        by = np.argsort(keys)
        keys = keys[by]
        new = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)))
        at, n = by[new], np.diff(np.append(new, len(by)))
        used = length[at] > 1
        at, n, keys = at[used], n[used], keys[new[used]]
        size = length[at].astype(np.int64)
        codes = np.zeros((len(at), order), np.uint32)
        for j in range(order):
            on = size > j
            codes[on, j] = s[begin + at[on] - size[on] + 1 + j]
        yield keys, n.astype(np.int64), groups[np.searchsorted(edge, begin + at, "right") - 1].astype(np.int32), codes


def window_counts(df: DataFrame, group: str, text: str, order: int, fold: bool = False) -> DataFrame:
    """(g int, gram, n long): how often each window stands in the texts of each group, written. Rows with a null group are left out."""

    def rows(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        _, n, g, codes = _merged(parts)
        grams = pa.array(codes.astype("<u4").view(f"<U{order}").ravel(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), grams, pa.array(n.astype(np.int64))], ["g", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            batch, at = batch.filter(pc.is_valid(batch.column(0))), 0
            for part in slices(batch.column(1), SLICE):
                groups = np.asarray(batch.column(0).slice(at, len(part))).astype(np.int64)
                at += len(part)
                for found in _windows(part, groups, order, fold):
                    held.append(found)
                    size += len(found[0])
                    if size > HELD:
                        held = [_merged(held)]
                        size = len(held[0][0])
                        if 4 * size > 3 * HELD:
                            yield rows(held)
                            held, size = [], 0
        if held:
            yield rows(held)

    partial = df.select(F.col(group).cast("int").alias("g"), F.col(text).alias("text")).mapInArrow(count, "g int, gram string, n long")
    return materialise(partial.groupBy("g", "gram").agg(F.sum("n").alias("n")))


def levels(counts: DataFrame, order: int, least: int = 1) -> list[DataFrame]:
    """(g, gram, a) by order from ``least``: from (g, gram, n), written, the adjusted count of each n-gram.

    The highest order, and n-grams at a text's start, have their raw counts; other
    n-grams the number of distinct symbols that stand before them.
    """
    out = [counts.where(F.length("gram") == order).select("g", "gram", F.col("n").alias("a"))]
    for k in range(order - 1, least - 1, -1):
        inner = out[0].groupBy("g", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("a"))
        out.insert(0, materialise(inner.unionByName(counts.where(F.length("gram") == k).select("g", "gram", F.col("n").alias("a")))))
    return out


def _discounts(level: DataFrame) -> DataFrame:
    """(of, order, d): the discounts of counts 1, 2 and 3 or more of each group and order, from the counts of counts of (g, gram, a); 0.75 where they can't be estimated."""
    n = level.groupBy("g", F.length("gram").alias("k")).agg(*(F.sum((F.col("a") == i).cast("long")).cast("double").alias(f"n{i}") for i in range(1, 5)))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    enough = F.least("n1", "n2", "n3", "n4") > 0
    d = [F.when(enough, F.lit(float(i)) - F.try_divide((i + 1) * y * F.col(f"n{i + 1}"), F.col(f"n{i}"))) for i in range(1, 4)]
    return n.select(F.col("g").alias("of"), F.col("k").alias("order"), F.array(*(F.when((x > 0) & (x < i), x).otherwise(0.75) for i, x in enumerate(d, 1))).alias("d"))


def log_probabilities(windows: DataFrame, by_order: list[DataFrame]) -> DataFrame:
    """(g, gram, logp double) for each of ``windows`` (g, gram; distinct, written), from the counts of :func:`levels`.

    An order takes its discounts off the counts and gives what they add up to to the order below;
    an order that has not met the context leaves all to the order below. An n-gram's length is its order, so
    counts, discounts and totals of all orders are joined at once; only the probabilities go from order to order.
    """
    order, below = len(by_order), None
    # written, as a plan that reads each order's table again for each use fills the driver's memory
    level = materialise(reduce(DataFrame.unionByName, [level.select("g", "gram", "a") for level in by_order]))
    discounts = small(materialise(_discounts(level)))
    level = level.join(discounts, (F.col("g") == F.col("of")) & (F.length("gram") == F.col("order"))).select("g", "gram", "a", F.least(F.col("d")[F.least("a", F.lit(3)).cast("int") - 1], "a").alias("spent"))
    context = F.expr("substring(gram, 1, length(gram) - 1)").alias("context")
    totals = level.groupBy("g", context).agg(F.sum("a").alias("total"), F.sum("spent").alias("all_spent"))
    # the ends of longer windows, too, as their probabilities go into those
    ends = F.array(*(F.when(F.length("gram") >= k, F.substring("gram", -k, k)) for k in range(1, order + 1)))
    mine = windows.select("g", F.explode(ends).alias("gram")).where("gram is not null").distinct()
    # a context meets few rows, as each is followed by a symbol of its own
    p = mine.join(level, ["g", "gram"], "left").select("g", "gram", "a", "spent", context).join(totals, ["g", "context"], "left")
    seen = F.coalesce((F.col("a") - F.col("spent")) / F.col("total"), F.lit(0.0))
    steps = materialise(p.select("g", "gram", seen.alias("seen"), F.coalesce(F.col("all_spent") / F.col("total"), F.lit(1.0)).alias("left")))
    for k in range(1, order + 1):
        p, lower = steps.where(F.length("gram") == k), F.lit(UNSEEN)
        if below is not None:
            p = p.withColumn("suffix", F.substring("gram", 2, k)).join(below.withColumnsRenamed({"gram": "suffix", "p": "lower"}), ["g", "suffix"], "left")
            lower = F.coalesce("lower", F.lit(UNSEEN))
        p = p.select("g", "gram", (F.col("seen") + F.col("left") * lower).alias("p"))
        if k < order:
            p = materialise(p)
            done = p if k == 1 else done.unionByName(p)  # noqa: F821
        below = p
    short = windows.where(F.length("gram") < order)  # at a text's start
    return below.unionByName(done.join(short, ["g", "gram"], "left_semi")).select("g", "gram", F.log("p").alias("logp"))


class SortedTable:
    """Values by sorted hash; an index on the leading bits leads to a place or two, so a look-up costs no binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        by = np.argsort(keys)
        self.keys, self.values = keys[by], values[by].astype(np.float32)
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    @staticmethod
    def of(rows: pa.Table | pa.RecordBatch) -> SortedTable:
        """From (g, gram, value)."""
        gram, g = rows["gram"], np.asarray(rows["g"]).astype(np.int64)
        gram = gram.combine_chunks() if isinstance(gram, pa.ChunkedArray) else gram
        gram = pa.concat_arrays([gram.cast(pa.string())]) if len(gram) else pa.array([], pa.string())
        return SortedTable(gram_keys(gram, g), np.asarray(rows["value"]))

    def look(self, wanted: np.ndarray) -> np.ndarray:
        """The value of each hash, else 0."""
        out = np.zeros(len(wanted), np.float32)
        bucket = (wanted >> self.shift).astype(np.int64)
        at, end = self.begin[bucket], self.begin[bucket + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            same = self.keys[at] == wanted[left]
            out[left[same]] = self.values[at[same]]
            on = ~same & (at + 1 < end)
            left, at, end = left[on], at[on] + 1, end[on]
        return out

    def along(self, s: np.ndarray, edge: np.ndarray, order: int, groups: np.ndarray) -> np.ndarray:
        """The value of each symbol's window; 0 for starts."""
        out = np.zeros(len(s), np.float32)
        for begin in range(0, len(s), BLOCK):
            end = min(begin + BLOCK, len(s))
            keys, length = window_keys(s, edge, order, groups, begin, end)
            out[begin:end] = np.where(length > 1, self.look(keys), 0)
        return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (g, gram, value) to (key, value)."""
    for batch in batches:
        keys = gram_keys(batch.column(1).cast(pa.string()), np.asarray(batch.column(0)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(2).cast(pa.float32())], ["key", "value"])


Measure = Callable[[pa.StringArray, np.ndarray, SortedTable], pa.Array]


def _measured(texts: pa.Array, groups: pa.Array, table: SortedTable, measure: Measure, kind: pa.DataType) -> pa.Array:
    out, at = [], 0
    for part in slices(texts, SLICE):
        out.append(measure(part, np.asarray(groups.slice(at, len(part))).astype(np.int64), table).cast(kind))
        at += len(part)
    return pa.concat_arrays(out) if out else pa.array([], kind)


def sent_to_all(values: DataFrame, most: int | None = None) -> Broadcast | None:
    """A broadcast of the table of ``values`` for :func:`with_values`; None if they are too many."""
    if values.count() > (BROADCAST_ROWS if most is None else most):
        return None
    found = values.select("g", "gram", "value").mapInArrow(_hashed, "key long, value float").toArrow()
    return values.sparkSession.sparkContext.broadcast(SortedTable(np.asarray(found["key"]).view(np.uint64), np.asarray(found["value"])))


def with_values(rows: DataFrame, text: str, group: str | Column, values: DataFrame, measure: Measure, kind: T.DataType, arrow: pa.DataType, out: str, order: int, fold: bool = False, most: int | None = None, sent: Broadcast | None = None) -> DataFrame:
    """``rows`` with ``out``: what ``measure`` makes of a text, its group (int) and the table of its windows' values.

    ``values``: (g, gram, value) of distinct windows, written; ``sent``: them as :func:`sent_to_all` gave them, where they are used
    several times. ``measure`` must not use other windows than the text's.
    """
    group = F.col(group) if isinstance(group, str) else group
    table = sent or sent_to_all(values, most)
    if table is not None:

        @F.arrow_udf(kind)
        def look(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for texts, groups in batches:
                yield _measured(texts, groups, table.value, measure, arrow)

        return rows.withColumn(out, look(F.col(text), group.cast("int")))
    return _in_chunks(rows, text, group, values, measure, kind, arrow, out, order, fold)


def _in_chunks(rows: DataFrame, text: str, group: Column, values: DataFrame, measure: Measure, kind: T.DataType, arrow: pa.DataType, out: str, order: int, fold: bool) -> DataFrame:
    """Row numbers are written with the rows, so that a chunk is the same whenever it is dealt."""
    (row,) = fresh(rows, "row")
    rows = materialise(rows.withColumn(row, F.monotonically_increasing_id()))
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunk = F.pmod(F.xxhash64(row), F.lit(1 + size // CHUNK_BYTES))
    texts = rows.select(chunk.alias("chunk"), F.col(row).alias("row"), F.col(text).alias("text"), group.cast("int").alias("g"))

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = np.asarray(batch.column(0))
            for c in np.unique(chunks):
                some, at = batch.filter(pa.array(chunks == c)), 0
                for part in slices(some.column(1), SLICE):
                    groups = np.asarray(some.column(2).slice(at, len(part))).astype(np.int64)
                    at += len(part)
                    for _, _, g, codes in _windows(part, groups, order, fold):
                        grams = pa.array(codes.astype("<u4").view(f"<U{order}").ravel(), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), c, np.int64)), pa.array(g.astype(np.int32)), grams], ["chunk", "g", "gram"])

    windows = texts.select("chunk", "text", "g").repartition("chunk").mapInArrow(grams_of, "chunk long, g int, gram string").distinct()
    found = windows.join(values, ["g", "gram"])

    def look(key: tuple, texts: pa.Table, table: pa.Table) -> pa.Table:
        column = _measured(texts["text"].combine_chunks(), texts["g"].combine_chunks(), SortedTable.of(table), measure, arrow)
        return pa.Table.from_arrays([texts["row"], column], ["row", "out"])

    pairs = texts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(look, T.StructType([T.StructField("row", T.LongType()), T.StructField("out", kind)]))
    taken = fresh(rows, "of")[0]
    joined = rows.join(pairs.withColumnRenamed("row", taken).withColumnRenamed("out", f"{taken}_v"), F.col(row) == F.col(taken))
    return joined.withColumn(out, F.col(f"{taken}_v")).drop(row, taken, f"{taken}_v")
