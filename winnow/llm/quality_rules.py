"""Quality rules: base counts of each text, and perplexity bands of a Kneser-Ney model.

Spark counts the character n-grams of every document by language, across its words; a
modified Kneser-Ney model of each language gives every document its perplexity per
symbol and per word, looked up from sorted hash arrays. From the whole corpus come
lower and upper bands of both for each language, some quartile ranges outside the
quartiles of the log perplexity (``BANDS``); a document outside its language's bands is
rejected. The bands widen for short texts, whose mean is less certain. Symbols that recur
make a text likely by symbol but not by word, so both are looked at; the lower band is wide,
as passages that many documents share are likely by rights.

Nulls: a null text counts as empty, a null language as a language of its own. Texts
without a word have no perplexity, fail the base rules and are not kept. Repeated
rows come out as often as they went in. Empty input gives no rows. Columns of the
input other than id, text and language are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm import charlm
from winnow.llm._common import materialise, small, table
from winnow.llm._text import data_of, encoded, offsets_of, slices, sums, words_of

ORDER = 5
#: By measure: how many quartile ranges the lower and the upper band lie outside the quartiles, and the symbols or words at which both are sqrt(2) times as wide as for a very long text.
BANDS = {"symbol": (4.0, 2.0, 400.0), "word": (3.0, 3.0, 100.0)}
WINDOW = 8
MIN_WORDS = 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def language_group(lang: Column) -> Column:
    """A hash of the language; null is a group of its own."""
    return F.coalesce(F.crc32(lang.cast("binary")).bitwiseAND(0x3FFFFFFF) + 1, F.lit(0)).cast("int")


def repeat_words(ids: np.ndarray, off: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text, the words that lie in a window found twice or more in it. ``ids``: a number for each word."""
    n = len(ids)
    if n < window:
        return np.zeros(len(off) - 1, np.int64)
    h, width = charlm._mix(ids.astype(np.uint64) + np.uint64(1)), 1
    while width < window:  # the hash of 2 * width words from those of width
        nxt = np.zeros_like(h)
        nxt[: n - width] = h[width:]
        h, width = charlm._mix(h * charlm._P + nxt), 2 * width
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    starts = np.flatnonzero(np.arange(n) + window <= off[1:][doc])
    key = charlm._mix(h[starts] + (doc[starts].astype(np.uint64) + np.uint64(1)) * charlm._C)
    by = np.argsort(key)
    same = key[by][1:] == key[by][:-1]
    twice = np.zeros(len(starts), bool)
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts[twice], 1)
    np.add.at(edge, starts[twice] + window, -1)
    return sums((np.cumsum(edge[:-1]) > 0).astype(np.int64), off)


def dup_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            n += line in seen
            seen.add(line)
    return n


def base_counts(texts: pa.StringArray, ids: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    data, at = data_of(texts), offsets_of(texts)
    at = at - at[0]
    raw = np.frombuffer(data, np.uint8)
    chars, symbols = sums((_LEAD[raw] & ~_SPACE[raw]).view(np.uint8), at), sums(_SYMBOL[raw].view(np.uint8), at)
    lines = np.array([dup_lines(data[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())], np.int64)
    return [np.diff(off), chars, symbols, lines, repeat_words(ids, off)]


KIND = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS] + [T.StructField("ll", T.DoubleType()), T.StructField("n_sym", T.LongType())])
_ARROW = pa.struct([(f, pa.int64()) for f in FIELDS] + [("ll", pa.float64()), ("n_sym", pa.int64())])


def measures(texts: pa.StringArray, groups: np.ndarray, table: charlm.SortedTable) -> pa.StructArray:
    """The base counts of each text, its log-likelihood under its group's model and its symbols, the end among them."""
    words, off = words_of(texts)
    _, ids = encoded(words)
    s, edge = charlm.symbols(texts)
    ll = sums(table.along(s, edge, ORDER, groups).astype(np.float64), edge)
    n = np.where(np.diff(off) > 0, np.diff(edge) - 1, 0)
    columns = [*base_counts(texts, ids, off), np.where(n > 0, ll, 0.0), n]
    return pa.StructArray.from_arrays([pa.array(c.astype(np.float64 if f.name == "ll" else np.int64)) for c, f in zip(columns, KIND)], KIND.names)


@F.arrow_udf(T.StructType(KIND.fields[: len(FIELDS)]))
def base_measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The base counts of texts."""
    for texts in batches:
        found = []
        for part in slices(texts):
            words, off = words_of(part)
            found.append(base_counts(part, encoded(words)[1], off))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0)] * len(FIELDS)
        yield pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], list(FIELDS))


def base_failed() -> Column:
    """Too few words, or too many in windows that recur."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def window_values(rows: DataFrame, group: str, text: str) -> DataFrame:
    """(g, gram, value): the log probability of every window of all texts, under the model of all texts of its group."""
    counts = charlm.window_counts(rows, group, text, ORDER)
    return materialise(charlm.log_probabilities(counts.select("g", "gram"), charlm.levels(counts, ORDER)).withColumnRenamed("logp", "value"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bands: dict[str, tuple[float, float, float]] = BANDS) -> DataFrame:
    """(id, base counts, log_ppl, word_log_ppl, their lower and upper bands, base_failed, kept) of each row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), language_group(F.col(lang_col)).alias("g"))
    scored = charlm.with_values(rows, "text", "g", window_values(rows, "g", "text"), measures, KIND, _ARROW, "m", ORDER).select("id", "g", "m.*")
    mean = lambda n: F.when(F.col("n_sym") > 0, -F.col("ll") / F.col(n))
    scored = materialise(scored.withColumns({"log_ppl": mean("n_sym"), "word_log_ppl": mean("n_words")}))
    at = lambda c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.75)), F.lit(10_000))
    quartiles = materialise(scored.where("n_sym > 0").groupBy("g").agg(at("log_ppl").alias("symbol"), at("word_log_ppl").alias("word")))
    out = scored.join(small(quartiles), "g", "left")
    fine = F.lit(True)
    for kind, (low, high, short) in bands.items():
        value, n = (F.col("log_ppl"), F.col("n_sym")) if kind == "symbol" else (F.col("word_log_ppl"), F.col("n_words"))
        q, reach = F.col(kind), F.sqrt(1 + F.lit(short) / F.greatest(n, F.lit(1)))
        reach = reach * (q[1] - q[0])
        out = out.withColumns({f"{kind}_low": q[0] - F.lit(low) * reach, f"{kind}_high": q[1] + F.lit(high) * reach})
        fine = fine & (value >= F.col(f"{kind}_low")) & (value <= F.col(f"{kind}_high"))
    return out.drop(*bands).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(fine, F.lit(False)))


def op10_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all documents."""
    out = judge(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), *FIELDS, "base_failed", "kept")


def quality_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of all documents, without the model."""
    counts = table(spark, sf_dir, "documents").select("doc_id", base_measures("text").alias("m")).select("doc_id", "m.*")
    return counts.withColumn("base_failed", base_failed())


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS c FROM k) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM t, (SELECT unnest(range(8)) AS o) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(w) < 20 OR 100 * coalesce(r.n, 0) > 30 * len(w) AS base_failed
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
"""
