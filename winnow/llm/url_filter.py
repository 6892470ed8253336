"""URL filters: rules first, then naive Bayes over segmented host and path words.

A host's labels are concatenated words more often than not. Each distinct label is split by
the unigram model that makes it likeliest (Viterbi over all splits, into words of any
length). The unigram counts come from the text and paths of all
pages; a label's candidate words meet them in a join, so the word list is never
broadcast. Multinomial naive Bayes learns from the pages that a rule decides and
judges the others by the words of host and path. Words that the rules name are left
out, as they would only repeat the rules; words that it has not met count for nothing.

All work is on distinct hosts, labels and urls; those that have a large share of the rows
of a join are sent to all tasks (:func:`join_by_key`), so that none is one task.

Nulls: a null url, or one without ``://``, has an empty host and path; no rule fits
it and it has no words, so the prior decides. A null page_id stays. Repeated rows come
out as often as they went in; ties go to allow. Without decided pages of both kinds
all others are allowed. Empty input gives no rows. An html column may be missing or
null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm._common import fresh, join_by_key, materialise, table

SEPARATOR = r"[.\-_:@]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Verdict and rule, host and path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as struct of rule and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def words_in(text: Column) -> Column:
    """Runs of a-z and 0-9, lower-cased."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def unigrams(pages: DataFrame) -> DataFrame:
    """(word, n): words of letters in the paths and, without tags, in the html of all pages."""
    sources = [path_of(F.col("url"))]
    if "html" in pages.columns:
        sources.append(F.coalesce(F.regexp_replace(F.col("html"), r"<[^>]*>", " "), F.lit("")))
    found = pages.select(F.explode(F.concat(*(words_in(s) for s in sources))).alias("word"))
    return found.where(F.col("word").rlike("^[a-z]+$")).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest split; an unknown word of k letters has probability 10 / (total * 10**k). Ties: fewer words, then a longer last word.

    An unknown word costs as much for each letter, so the best place for it to begin is carried along; known words end
    at a place by length. Time is linear in the label for given lengths.
    """
    lengths = sorted({len(w) for w in counts})
    unknown, letter = log(10.0 / max(total, 1)), log(10.0)
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]  # score, less the words, less the last word's begin
    begin = (0.0, 0, 0)  # the best begin of an unknown word: its score, as if letters before it had been paid for
    for i in range(1, len(label) + 1):
        options = [(begin[0] + unknown - i * letter, begin[1] - 1, begin[2])]
        for k in lengths:
            if k > i:
                break
            n = counts.get(label[i - k : i])
            if n:
                options.append((best[i - k][0] + log(n / total), best[i - k][1] - 1, k - i))
        best.append(max(options))
        begin = max(begin, (best[i][0] + i * letter, best[i][1], -i))
    out, i = [], len(label)
    while i:
        j = -best[i][2]
        out.append(label[j:i])
        i = j
    return out[::-1]


@F.arrow_udf(T.ArrayType(T.StringType()))
def split_labels(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for labels, found, total in batches:
        rows = zip(labels.to_pylist(), found.to_pylist(), total.to_pylist())
        yield pa.array([viterbi(x, {e["word"]: e["n"] for e in f or [] if e["word"]}, t) for x, f, t in rows], pa.list_(pa.string()))


def segmented_labels(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) of the distinct labels in (host)."""
    labels = materialise(hosts.select(F.explode(F.split("host", SEPARATOR)).alias("label")).where("label != ''").distinct())
    longest = labels.agg(F.coalesce(F.max(F.length("label")), F.lit(0))).first()[0]
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # lengths that known words have, of which m need a text of m * m / 2 letters
    lengths = [r[0] for r in counts.where(F.length("word") <= longest).select(F.length("word").alias("k")).distinct().orderBy("k").collect()]
    # a row a place, then a row a length: no label is held with all its pieces
    places = labels.select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("at"))
    fits = F.filter(F.lit(lengths) if lengths else F.array().cast("array<int>"), lambda k: k <= F.length("label") - F.col("at") + 1)
    pieces = places.select("label", "at", F.explode(fits).alias("k")).select("label", F.col("label").substr(F.col("at"), F.col("k")).alias("word"))
    # known pieces only; a label of which none is known still needs its row
    known = pieces.distinct().join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("found"))
    return labels.join(known, "label", "left").select("label", split_labels("label", "found", F.lit(total).cast("long")).alias("words"))


def bayes(tokens: DataFrame) -> DataFrame | None:
    """From (token, block 0/1, n) to (token, weight), the log odds for block with add-one smoothing. None if a class is missing."""
    counts = materialise(tokens.groupBy("token").agg(F.sum(F.col("block") * F.col("n")).alias("b"), F.sum((1 - F.col("block")) * F.col("n")).alias("a")))
    t = counts.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count("*").alias("v")).first()
    if not t["b"] or not t["a"]:
        return None
    weight = F.log((F.col("b") + 1) / (t["b"] + t["v"])) - F.log((F.col("a") + 1) / (t["a"] + t["v"]))
    return materialise(counts.select("token", weight.alias("weight")))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict, host_words and log_odds (of block; null where a rule decides). Columns of these names are replaced."""
    names = ("host", "path", "rule", "verdict", "host_words", "log_odds")
    counts = materialise(unigrams(pages))
    (r,) = fresh(pages, "r")
    pages = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).drop(*names[2:])
    urls = pages.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("url", _url_key()).withColumn(r, longest_rule(F.col("host"), F.col("path"), rules))
    urls = materialise(urls)
    labels = materialise(segmented_labels(urls.select("host").distinct(), counts))
    parts = materialise(urls.select("host").distinct().select("host", F.posexplode(F.split("host", SEPARATOR)).alias("i", "label")).where("label != ''"))
    pieces = join_by_key(parts, labels, "label")
    hosts = materialise(pieces.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "words"))), lambda x: x["words"])).alias("host_words")))
    # a host's pages are summed before its words are counted; a path's words per distinct url
    decided = urls.where(F.col(r).isNotNull()).withColumn("block", (F.col(f"{r}.verdict") == "block").cast("long"))
    host_tokens = decided.groupBy("host", "block").agg(F.sum("n").alias("n")).join(hosts, "host").select(F.explode("host_words").alias("token"), "block", "n")
    path_tokens = decided.select(F.explode(words_in(F.col("path"))).alias("token"), "block", "n")
    named = sorted({w for _, rule in rules for w in re.findall("[a-z0-9]+", rule)})
    tag = lambda df, kind: df.where(~F.col("token").isin(named)).select(F.concat(F.lit(f"{kind}:"), "token").alias("token"), "block", "n")
    weights = bayes(tag(host_tokens, "h").unionByName(tag(path_tokens, "p")))
    if weights:
        n = decided.groupBy("block").agg(F.sum("n").alias("n")).collect()
        prior = log(max(1, sum(x["n"] for x in n if x["block"]))) - log(max(1, sum(x["n"] for x in n if not x["block"])))
        score = F.coalesce(F.sum("weight"), F.lit(0.0))
        host_words = materialise(hosts.select("host", F.explode("host_words").alias("w")).select("host", F.concat(F.lit("h:"), "w").alias("token")))
        path_words = materialise(urls.where(F.col(r).isNull()).select("url", F.explode(words_in(F.col("path"))).alias("w")).select("url", F.concat(F.lit("p:"), "w").alias("token")))
        h = join_by_key(host_words, weights, "token").groupBy("host").agg(score.alias("hs"))
        p = join_by_key(path_words, weights, "token").groupBy("url").agg(score.alias("ps"))
        scores = materialise(hosts.join(h, "host", "left"))
        urls = materialise(urls.join(p, "url", "left"))
        odds = F.when(F.col(r).isNull(), F.lit(prior) + F.coalesce("hs", F.lit(0.0)) + F.coalesce("ps", F.lit(0.0)))
    else:
        scores, odds = hosts, F.lit(None).cast("double")
    verdict = F.coalesce(F.col(f"{r}.verdict"), F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    judged = join_by_key(urls, scores, "host").withColumn("log_odds", odds)
    judged = materialise(judged.select("url", F.col(f"{r}.rule").alias("rule"), verdict.alias("verdict"), "host_words", "log_odds"))
    (key,) = fresh(pages, "url_key")
    return join_by_key(pages.withColumn(key, _url_key()), judged.withColumnRenamed("url", key), key).drop(key)


def _url_key() -> Column:
    return F.struct("host", "path")


def op5_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.array_join("host_words", " ").alias("host_words"), "log_odds")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every page, without the classifier."""
    pages = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return pages.withColumn("rule", longest_rule(F.col("host"), F.col("path"))["rule"])


URL_SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
"""
