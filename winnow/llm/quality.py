"""Quality classifier by co-training of two views.

One classifier sees the text (the shares of its lower-cased words in ``SLOTS`` slots of
their hash, and of symbols, capitals, repeats, word and line lengths), the other only the
page's metadata (language, source, stated length). Both start from the labelled rows. In
each round either classifier labels the unlabelled documents of which it is confident, and
the other learns from them as well, with less weight. In the end each view is calibrated on
labelled rows that neither has learned from, and the two log odds are added (less the prior,
which both hold) to score every document. Labels of the held-out fold are never read.

Features of whole texts are computed once and written; a Newton step of both
logistic regressions is one pass that sums d x d moments in every task and then by
Spark, so no rows come to the driver, and pseudo-labels cover all documents. The
``LANGS`` and ``SOURCES`` values that most documents have get a feature each, all others share
``RARE`` features by their hash. Only the calibration takes a sample of labelled rows,
``MAX_CALIBRATION`` at most.

Nulls: a null text counts as empty, null metadata as a value of its own. A null label
or id teaches nothing; an id with several labels is taken at the lowest. Repeated
rows are scored alike. Without labels of both kinds all scores are 0.5. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm._common import materialise, table
from winnow.llm._text import LOWER, data_of, encoded, offsets_of, slices, sums, translated, words_of
from winnow.llm.near_copies import word_hashes
from winnow.llm.quality_rules import base_counts
from winnow.llm.toxicity import HELD_OUT, fit_logistic, fold

ROUNDS = 3
STEPS = 5
CONFIDENT = 0.95
PSEUDO_WEIGHT = 0.2
RIDGE = 1.0
MAX_CALIBRATION = 100_000
CALIBRATION_FOLD = 1
LANGS, SOURCES, RARE = 16, 64, 8
SURFACE, SLOTS = 16, 128
TEXT_SIZE, META_SIZE = SURFACE + SLOTS, 3 + LANGS + SOURCES + 2 * RARE

_UPPER, _DIGIT, _MARK, _SPACE, _LEAD = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LEAD[:] = (np.arange(256) & 0xC0) != 0x80


def text_features(texts: pa.StringArray) -> np.ndarray:
    """A row of ``TEXT_SIZE`` numbers, about 0 to 2 each, for each text."""
    words, off = words_of(texts)
    distinct, ids = encoded(words)
    n_words, chars, symbols, dup_lines, repeats = base_counts(texts, ids, off)
    data, at = data_of(texts), offsets_of(texts)
    at = at - at[0]
    raw = np.frombuffer(data, np.uint8)
    share = lambda tab: sums(tab[raw].view(np.uint8), at) / np.maximum(chars, 1)
    n_lines = sums((raw == 10).view(np.uint8), at) + 1
    doc = np.repeat(np.arange(len(texts)), np.diff(off))
    pairs, n = np.unique(doc.astype(np.int64) * (1 << 32) + ids, return_counts=True)
    kinds = np.bincount(pairs >> 32, minlength=len(texts))
    most = np.zeros(len(texts))
    np.maximum.at(most, pairs >> 32, n)
    w = np.maximum(n_words, 1)
    marked = np.array([any(c in b"#*$%&|<>" for c in x) for x in (d.encode() for d in distinct.to_pylist())], bool)
    upper = np.array([len(x) > 1 and x.isupper() for x in distinct.to_pylist()], bool)
    word_share = lambda flags: sums(flags[ids].astype(np.int64), off) / w if len(ids) else np.zeros(len(texts))
    lower = np.asarray(word_hashes(translated(distinct, LOWER)) >> np.uint64(40)).astype(np.int64) % SLOTS
    slots = np.bincount(doc * SLOTS + lower[ids], minlength=len(texts) * SLOTS).reshape(-1, SLOTS) if len(ids) else np.zeros((len(texts), SLOTS))
    surface = np.column_stack([
        symbols / np.maximum(chars, 1), share(_UPPER), share(_DIGIT), share(_MARK), chars / w / 10, kinds / w, most / w,
        dup_lines / n_lines, repeats / w, np.log1p(n_words) / 10, np.log1p(n_lines) / 10, np.log1p(w / n_lines) / 10,
        word_share(marked), word_share(upper), n_words == 0, n_words < 20,
    ])
    return np.hstack([surface, np.sqrt(slots / w[:, None])]).astype(np.float32)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def text_view(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        x = np.concatenate([text_features(p) for p in slices(texts)]) if len(texts) else np.zeros((0, TEXT_SIZE), np.float32)
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * TEXT_SIZE), pa.array(x.ravel()))


def common_values(docs: DataFrame, column: str, most: int) -> list[str]:
    """The values of a column that most rows have, ``most`` of them at most; null is not among them."""
    counts = docs.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
    return [r["v"] for r in counts.orderBy(F.col("n").desc(), "v").limit(most).collect()]


def metadata_view(lang: Column, source: Column, n_chars: Column, langs: list[str], sources: list[str]) -> Column:
    """One feature for each common language and source, ``RARE`` for the others of each, null among them, and the stated length."""

    def hot(c: Column, values: list[str], n: int) -> Column:
        rare = F.pmod(F.xxhash64(F.coalesce(c.cast("string"), F.lit("\x00"))), F.lit(RARE)) + n + 1
        known = F.array_position(F.array(*map(F.lit, values)).cast("array<string>"), c.cast("string"))
        slot = F.when(F.coalesce(known, F.lit(0)) > 0, known).otherwise(rare)
        return F.transform(F.sequence(F.lit(1), F.lit(n + RARE)), lambda i: (slot == i).cast("float"))

    size = F.log1p(F.greatest(F.coalesce(n_chars, F.lit(0)), F.lit(0)).cast("double")) / 10
    return F.concat(F.array(size.cast("float"), (size * size).cast("float"), n_chars.isNull().cast("float")), hot(lang, langs, LANGS), hot(source, sources, SOURCES))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.hstack([np.asarray(column.flatten()).astype(np.float64).reshape(-1, width), np.ones((len(column), 1))])


def _newton_pass(rows: DataFrame, now: list[np.ndarray], teachers: list[np.ndarray] | None) -> list[np.ndarray]:
    """New weights of both views after one Newton step over all rows (text, meta, y: null where not labelled)."""
    widths = [TEXT_SIZE, META_SIZE]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((w + 1, w + 2)) for w in widths]
        for batch in batches:
            xs = [_matrix(batch.column(i), w) for i, w in enumerate(widths)]
            y = np.asarray(batch.column(2).fill_null(-1)).astype(np.int64)
            for i in range(2):
                label, weight = y.astype(float), (y >= 0).astype(float)
                if teachers is not None:  # what the other view is sure of
                    p = _sigmoid(xs[1 - i] @ teachers[1 - i])
                    sure = (y < 0) & ((p >= CONFIDENT) | (p <= 1 - CONFIDENT))
                    label, weight = np.where(sure, p >= 0.5, label), np.where(sure, PSEUDO_WEIGHT, weight)
                used = weight > 0
                x, p = xs[i][used], _sigmoid(xs[i][used] @ now[i])
                w = weight[used]
                total[i][:, :-1] += (x * (w * p * (1 - p))[:, None]).T @ x
                total[i][:, -1] += x.T @ (w * (label[used] - p))
        flat = np.concatenate([t.ravel() for t in total])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

    sums_ = rows.select("text_x", "meta_x", "y").mapInArrow(moments, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(sum((w + 1) * (w + 2) for w in widths))
    flat[np.asarray(sums_["i"])] = np.asarray(sums_["v"])
    out, at = [], 0
    for i, w in enumerate(widths):
        t = flat[at : at + (w + 1) * (w + 2)].reshape(w + 1, w + 2)
        at += t.size
        pen = np.full(w + 1, RIDGE)
        pen[-1] = 1e-3
        out.append(now[i] + np.clip(np.linalg.solve(t[:, :-1] + np.diag(pen), t[:, -1] - pen * now[i]), -5, 5))
    return out


def co_train(rows: DataFrame) -> list[np.ndarray]:
    """The weights of the text view and the metadata view, from rows (text_x, meta_x, y)."""
    now: list[np.ndarray] = [np.zeros(TEXT_SIZE + 1), np.zeros(META_SIZE + 1)]
    teachers = None
    for r in range(1 + ROUNDS):
        for _ in range(STEPS if r == 0 else 2):
            now = _newton_pass(rows, now, teachers)
        teachers = [w.copy() for w in now]
    return now


def _odds(x: str, w: np.ndarray) -> Column:
    weights = np.asarray(w, np.float64)

    @F.arrow_udf(T.DoubleType())
    def odds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(_matrix(column, len(weights) - 1) @ weights)

    return odds(x)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text_score, meta_score, score) of each row of ``docs`` (doc_id, text, lang, source, n_chars)."""
    meta = metadata_view(F.col("lang"), F.col("source"), F.col("n_chars"), common_values(docs, "lang", LANGS), common_values(docs, "source", SOURCES))
    x = docs.select("doc_id", text_view("text").alias("text_x"), meta.alias("meta_x"))
    known = labels.where("doc_id is not null and quality is not null").where(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label"))
    x = materialise(x.join(known, "doc_id", "left").withColumn("fold", fold(F.col("doc_id"))))
    classes = x.where("label is not null").select("label", (F.col("fold") == CALIBRATION_FOLD).alias("c")).distinct().collect()
    if len(classes) < 4:
        return x.select("doc_id", *(F.lit(0.5).alias(c) for c in ("text_score", "meta_score", "score")))
    # rows for calibration teach nothing, neither by label nor by pseudo-label
    rows = x.where(F.col("label").isNull() | (F.col("fold") != CALIBRATION_FOLD)).select("text_x", "meta_x", F.col("label").alias("y"))
    w = co_train(rows)
    z = x.select("doc_id", "label", "fold", _odds("text_x", w[0]).alias("zt"), _odds("meta_x", w[1]).alias("zm"))
    held = z.where((F.col("fold") == CALIBRATION_FOLD) & F.col("label").isNotNull())
    n = held.count()
    held = held if n <= MAX_CALIBRATION else held.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * MAX_CALIBRATION / n))
    t = held.select("zt", "zm", "label").toArrow()
    y = np.asarray(t["label"]).astype(float)
    prior = float(np.log(y.mean() / (1 - y.mean()))) if 0 < y.mean() < 1 else 0.0
    a, b = (fit_logistic(np.asarray(t[c])[:, None], y, 1e-3) for c in ("zt", "zm"))
    ct, cm = F.col("zt") * float(a[0]) + float(a[1]), F.col("zm") * float(b[0]) + float(b[1])
    p = lambda odds: 1 / (1 + F.exp(-odds))
    return z.select("doc_id", p(ct).alias("text_score"), p(cm).alias("meta_score"), p(ct + cm - prior).alias("score"))


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; kept: a score of 0.5 or more."""
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "text_score", "meta_score", "score", (F.col("score") >= 0.5).alias("kept"))
