"""Spelling variants: rare words are grouped under common ones that differ by one code point.

Words are counted over all texts. Pairs of words at distance one are found by a symmetric-delete join:
every word emits a key of itself and of each of its distinct single deletions, words meet on equal keys,
and pairs that meet are compared exactly, as keys are hashes and two deletions can also lie two changes
apart. A word meets only words that its key plus one code point spells, so the rows of a key are bounded by
the alphabet and the word's length, not by the table. Keys are computed in one sweep over a word's code points,
so a word of any length costs as many numbers as it has code points; strings are
joined to the pairs that are left.

A word's form is its near word with the most occurrences (ties: the smallest in code-point order), if that has
``times`` as many; its root is where forms lead to. Occurrences grow with each form, so the chain has an end,
and following it doubles its reach in every round.

Counting reads maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased. To have misspellings of a known rate, the
registered query drops a letter from one in ``every`` runs, by a CRC-32 of the document's id and the run.
A null text has no words; a null id counts as an empty one. Repeated rows count as often as they stand there. An empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm._common import discard, materialise, table
from winnow.llm._text import LOWER, data_of, offsets_of, slices, words_of
from winnow.llm.charlm import _C, _P, _mix

#: Code points, occurrences, and how many times as many a form has.
LENGTH, LEAST, TIMES = 6, 5, 5
EVERY = 199
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def runs_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Lower-cased runs of letters of all texts, and where each text's begin, with the end of the last.

    U+00C0 to U+00FF are the two bytes C3 80 to C3 BF, and C3 leads no others.
    """
    raw = np.frombuffer(data_of(texts).translate(LOWER), np.uint8)
    lead = raw == 0xC3
    letter = ((raw >= 97) & (raw <= 122)) | lead
    letter[1:] |= lead[:-1]
    off = (offsets_of(texts) - offsets_of(texts)[0]).astype(np.int32)
    return words_of(pa.StringArray.from_buffers(len(texts), pa.py_buffer(off), pa.py_buffer(np.where(letter, raw, np.uint8(32)).tobytes())))


def _shortened(run: str, h: int) -> str:
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def run_counts(docs: DataFrame, every: int | None = EVERY) -> DataFrame:
    """(word, n) of (doc_id, text): counts by slices of texts, to be added up. ``every``: see above; None leaves all runs as they are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for part in slices(batch.column(1)):
                runs, off = runs_of(part)
                d = pc.dictionary_encode(runs)
                words, which = d.dictionary.to_pylist(), np.asarray(d.indices).astype(np.int64)
                # one row for each run of a text
                pair, times = np.unique(np.repeat(np.arange(len(part)), np.diff(off)) * max(1, len(words)) + which, return_counts=True)
                doc, word = pair // max(1, len(words)), pair % max(1, len(words))
                total = np.bincount(word, times, minlength=len(words)).astype(np.int64)
                extra: dict[str, int] = {}
                if every:
                    starts = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[at : at + len(part)]]
                    coded = [w.encode() for w in words]
                    h = np.fromiter((zlib.crc32(coded[w], starts[i]) for i, w in zip(doc.tolist(), word.tolist())), np.int64, len(doc))
                    for k in np.flatnonzero(h % every == 0).tolist():
                        total[word[k]] -= times[k]
                        short = _shortened(words[word[k]], int(h[k]))
                        extra[short] = extra.get(short, 0) + int(times[k])
                at += len(part)
                keep = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([*(words[i] for i in keep.tolist()), *extra], pa.string()), pa.array(np.concatenate([total[keep], np.array(list(extra.values()), np.int64)]))], ["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long")


def vocabulary(docs: DataFrame, length: int = LENGTH, least: int = LEAST, every: int | None = EVERY) -> DataFrame:
    """(word, n) of the words of at least ``length`` code points with at least ``least`` occurrences in all texts."""
    counts = run_counts(docs, every).where(F.char_length("word") >= length)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def deletion_hashes(word: str) -> np.ndarray:
    """64-bit hashes of a word and of its distinct single deletions: a polynomial of the code points, by prefixes and suffixes."""
    code = _mix(np.array([*map(ord, word)], np.uint64) * _C)
    n = len(code)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _P)]))
    head = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power[:-1])])
    # what stands after a deleted place moves down by one
    cut = head[:-1] + (head[-1:] - head[1:]) * np.array([_INVERSE])
    lengths = np.concatenate([np.array([n], np.uint64), np.full(n, max(0, n - 1), np.uint64)])
    return np.unique(_mix(np.concatenate([head[-1:], cut]) + lengths * _C))


@F.arrow_udf(T.ArrayType(T.LongType()))
def delete_keys(words: pa.Array) -> pa.Array:
    """The keys that a word emits: of itself and of its distinct single deletions."""
    keys = [deletion_hashes(w) for w in words.to_pylist()]
    off = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(keys or [np.zeros(0, np.uint64)]).view(np.int64)))


def one_apart(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


@F.arrow_udf(T.BooleanType())
def are_one_apart(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([one_apart(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())


def near_words(words: DataFrame) -> DataFrame:
    """(a, b): the pairs of distinct words (word) at distance one, each in both orders."""
    named = materialise(words.select("word", F.xxhash64("word").alias("w"), F.xxhash64(F.lit(1), "word").alias("v")))
    # a word goes by two hashes, 128 bits, until pairs are found
    keyed = named.select(F.struct("w", "v").alias("id"), F.explode(delete_keys("word")).alias("key"))
    a, b = keyed.select("key", F.col("id").alias("a")), keyed.select("key", F.col("id").alias("b"))
    met = a.join(b, (a.key == b.key) & (F.col("a") < F.col("b"))).select("a", "b").distinct()
    text = named.select(F.struct("w", "v").alias("id"), "word")
    both = met.join(text.toDF("a", "x"), "a").join(text.toDF("b", "y"), "b").where(are_one_apart("x", "y")).select("x", "y")
    return both.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), where forms lead to words without one: pointers are joined with themselves until none moves."""
    at = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialise(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(at)
        done = after.where("moved").isEmpty()
        at = after.drop("moved")
        if done:
            return at


def spelling_groups(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n)."""
    words = materialise(words.select("word", "n"))
    pairs = near_words(words).join(words.toDF("b", "b_n"), "b")
    order = F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("w"))
    best = pairs.groupBy("a").agg(F.count("*").alias("n_near"), F.min(order).alias("best"))
    enough = -F.col("best.n") >= F.col("n") * times
    rows = words.join(best.withColumnRenamed("a", "word"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.w")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")
    )
    rows = materialise(rows)
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of six code points and five occurrences in all documents."""
    return spelling_groups(vocabulary(table(spark, sf_dir, "documents")))


#: CRC-32 (reflected polynomial EDB88320) by a table of 256 entries, over the bytes of ``<id>:<run>``.
OP11_SQL = """WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS w FROM documents),
l AS MATERIALIZED (SELECT id, w, count(*) AS n FROM (SELECT id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM r) GROUP BY ALL),
c AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda v, j: CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
h AS (SELECT l.*, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || x)::BIGINT for x in regexp_extract_all(hex(encode(id || ':' || w)), '..')]), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM l, c),
s AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
k AS MATERIALIZED (SELECT DISTINCT word, n, unnest(list_append([substr(word, 1, i) || substr(word, i + 2) for i in range(0, length(word))], word)) AS key FROM v),
p AS MATERIALIZED (SELECT DISTINCT a.word AS a, b.word AS b, b.n AS n FROM k a JOIN k b USING (key) WHERE a.word <> b.word AND CASE length(a.word) - length(b.word) WHEN 0 THEN len([i for i in range(1, length(a.word) + 1) if substr(a.word, i, 1) <> substr(b.word, i, 1)]) = 1 WHEN 1 THEN key = b.word WHEN -1 THEN key = a.word ELSE false END),
q AS (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rn, count(*) OVER (PARTITION BY a) AS near FROM p),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(near, 0) AS n_near, CASE WHEN q.n >= 5 * v.n THEN q.b END AS form, CASE WHEN q.n >= 5 * v.n THEN q.n END AS form_n FROM v LEFT JOIN q ON v.word = q.a AND rn = 1),
e AS (SELECT word, word AS at FROM f UNION ALL SELECT e.word, f.form FROM e JOIN f ON e.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, e.at AS root, f.n, f.n_near, f.form_n FROM f JOIN e ON f.word = e.word JOIN f g ON e.at = g.word AND g.form IS NULL"""
