"""Toxicity by class-conditional Kneser-Ney models.

Two character n-gram models of whole lower-cased texts, one of toxic and one of
ordinary texts, share the counts of their lower orders: what neither class has seen
backs off to the same distribution and cancels out. The context of a symbol reaches over
words, so that an expression of several words counts as such. Each symbol's log ratio
is the difference of its log probabilities under the two. A text's features are the mean of
these (the length-normalised log-likelihoods compared), and the sums over single words:
how many words exceed some ratios, and the highest ones. A logistic curve on labelled rows
that the counts have not seen turns the features into a score.

The counts take all labelled rows of the learning folds but one; the curve takes that
one, ``MAX_LABELLED`` of its rows at most (by a hash of the id). Scores cover every document
and its whole text.

Nulls: a null or empty text, and one without words, scores 0; labels with a null id or null label are ignored; a document id with several
labels counts as toxic if one of them is. Repeated rows score alike. Without labels
of both classes every score is 0. Empty input gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm import charlm
from winnow.llm._common import fresh, materialise, small, table
from winnow.llm._text import sums

ORDER, SHARED = 5, 2
MAX_LABELLED = 200_000
TOPS, CAP = 8, 8.0
STRONG = (1.0, 2.0, 3.0, 4.0)
FEATURES = 2 + len(STRONG) + TOPS
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
POOL = 2


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def learning_rows(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y, fold) of all labelled rows outside the held-out fold, written."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    return materialise(rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")).withColumn("fold", fold(F.col("doc_id"))))


def window_gaps(docs: DataFrame, rows: DataFrame, order: int = ORDER) -> DataFrame | None:
    """(g, gram, value): for every window of all texts, its log probability under the toxic model less that under the ordinary one; None if a class has no text.

    The models learn from ``rows`` (doc_id, y); orders up to ``SHARED`` are those of both classes together.
    """
    known = rows.select(F.col("doc_id").alias("labelled"), "y")
    seen = docs.select("doc_id", "text").join(small(known, MAX_LABELLED), F.col("doc_id") == F.col("labelled"), "left")
    # one reading of all texts: classes 0 and 1, and the rest
    counts = charlm.window_counts(seen.select(F.coalesce("y", F.lit(POOL)).alias("g"), "text"), "g", "text", order, True)
    classes = counts.where(F.col("g") != POOL)
    if classes.select("g").distinct().count() < 2:
        return None
    pooled = materialise(classes.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(POOL).alias("g"), "gram", "n"))
    both = F.explode(F.array(F.lit(0), F.lit(1)))
    lower = [level.select(both.alias("g"), "gram", "a") for level in charlm.levels(pooled, order)[:SHARED]]
    own = charlm.levels(classes, order, SHARED + 1)
    windows = materialise(counts.select("gram").distinct())
    logp = charlm.log_probabilities(windows.select(both.alias("g"), "gram"), lower + own)
    gap = F.sum(F.when(F.col("g") == 1, F.col("logp")).otherwise(-F.col("logp")))
    return materialise(logp.groupBy("gram").agg(gap.alias("value")).select(F.lit(0).alias("g"), "gram", "value"))


def text_features(texts: pa.StringArray, groups: np.ndarray, table: charlm.SortedTable) -> pa.ListArray:
    """``FEATURES`` numbers for each text: its ratio per symbol, logarithms of its strong words by threshold and of all its words, its most toxic words' ratios up to ``CAP``."""
    s, edge = charlm.symbols(texts, True)
    gaps = table.along(s, edge, ORDER, groups).astype(np.float64)
    closes = (s == 32) | (s == 10)
    closes[edge[1:] - 1] = True
    ends = np.flatnonzero(closes) + 1  # of words, with the symbol that closes each
    words = np.diff(np.concatenate([[0.0], np.cumsum(gaps)])[np.concatenate([[0], ends])])
    off = np.searchsorted(ends, edge, "right")
    some = np.diff(edge) > 2  # texts without words have no features
    out = np.zeros((len(texts), FEATURES))
    out[:, 0] = sums(gaps, edge) / np.maximum(np.diff(edge) - 1, 1)
    for j, least in enumerate(STRONG):
        out[:, 1 + j] = np.log1p(sums((words > least).astype(np.int64), off))
    out[:, 1 + len(STRONG)] = np.log1p(np.diff(off))
    for i in np.flatnonzero(some).tolist():
        v = words[off[i] : off[i + 1]]
        top = np.sort(np.partition(v, max(0, len(v) - TOPS))[-TOPS:])[::-1]
        out[i, 2 + len(STRONG) : 2 + len(STRONG) + len(top)] = np.clip(top, 0, CAP)
    out[~some] = 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression, by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, pen = np.zeros(x1.shape[1]), np.full(x1.shape[1], ridge)
    pen[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(pen), x1.T @ (y - p) - pen * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_documents(docs: DataFrame, labels: DataFrame, score: str = "score") -> DataFrame:
    """``docs`` (doc_id and text among its columns) with a score from 0 to 1 in a column ``score``, which replaces one of that name."""
    docs = docs.drop(score)
    rows = learning_rows(labels, "toxic")
    gaps = window_gaps(docs, rows.where(F.col("fold") != CALIBRATION))
    if gaps is None:
        return docs.withColumn(score, F.lit(0.0))
    (x,) = fresh(docs, "features")
    sent = charlm.sent_to_all(gaps)
    numbers = lambda some: charlm.with_values(some, "text", F.lit(0), gaps, text_features, T.ArrayType(T.DoubleType()), pa.list_(pa.float64()), x, ORDER, True, sent=sent)
    # a second reading of some labelled rows, for the curve only
    known = rows.where(F.col("fold") == CALIBRATION).select(F.col("doc_id").alias("labelled"), "y")
    n = known.count()
    known = known if n <= MAX_LABELLED else known.where(F.pmod(F.xxhash64("labelled"), F.lit(1 << 20)) < int((1 << 20) * MAX_LABELLED / n))
    held = docs.select("doc_id", "text").join(small(known, 2 * MAX_LABELLED), F.col("doc_id") == F.col("labelled"))
    fitted = numbers(held.select("y", "text")).select("y", F.col(x).alias("x")).toArrow()
    w = calibrate(np.array(fitted["x"].to_pylist()).reshape(-1, FEATURES), np.asarray(fitted["y"]).astype(float))
    z = F.lit(float(w[-1]))
    for i in range(len(w) - 1):
        z = z + F.lit(float(w[i])) * F.col(x)[i]
    no_words = F.col(x)[1 + len(STRONG)] == 0
    return numbers(docs).withColumn(score, F.when(no_words, 0.0).otherwise(1 / (1 + F.exp(-z)))).drop(x)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score under 0.5; columns as before."""
    (score,) = fresh(docs, "score")
    return score_documents(docs, labels, score).where(F.col(score) < 0.5).drop(score)


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if not len(y) or y.min() == y.max():
        return np.array([0.0] * FEATURES + [0.0 if not len(y) else 30 * (2 * y.max() - 1)])
    return fit_logistic(x, y)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    scored = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
