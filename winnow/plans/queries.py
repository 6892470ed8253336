"""The library's queries over the test tables, and SQL that gives the same rows.

Records are documents with their labels; the pool and the reference are the two
seeded halves of each class of the embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.order import content_key
from winnow.operators import curation, gates, models, pairs, quantiles, report, sampling, selectors, setmetrics
from winnow.plans import pipelines
from winnow.sources.scratch import written

SIGMA = 1.0
N = 10
SMALL = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    value = F.when(F.col("quality") == 1, "1.0").when(F.col("quality") == 0, "0.0")
    flag = F.when(F.col("toxic") == 1, "1.0").when(F.col("quality") == 0, "-1.0").when(F.col("quality") == 1, "0.0")
    return docs.join(labels, "doc_id", "left").withColumn("label", value).withColumn("flag", flag)


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = written(sampling.split_halves(pairs.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("label").alias("cls")), "cls"))
    return rows.where("part = 'select'").drop("part"), rows.where("part = 'eval'").drop("part")


def one(spark: SparkSession, **values) -> DataFrame:
    """A row of numbers that an operator returns."""
    return spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{c} double" for c in values))


def label_map_counts(spark, sf_dir):
    r = records(spark, sf_dir)
    strict = r.withColumn("cls", curation.label_of(F.col("label"), "good", "normal")).where("cls is not null")
    loose = r.withColumn("cls", curation.label_or_normal(F.col("label"), "good", "normal"))
    counts = lambda df, kind: curation.split_counts(df, "lang", "cls", "source").select(F.lit(kind).alias("kind"), "lang", "cls", "n", "subjects")
    return counts(strict, "strict").unionByName(counts(loose, "loose"))


def flag_bucket_report(spark, sf_dir):
    r = records(spark, sf_dir)
    flags = r.where("quality is not null").select("doc_id", "flag")
    out = curation.flag_report(r.select("doc_id", "lang"), flags, ["doc_id"], "lang")
    return out.select("lang", "bucket", "n", F.round("share", 6).alias("share"))


def last_flag_wins(spark, sf_dir):
    return curation.last_flags(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


def _dropped(spark, sf_dir):
    r = records(spark, sf_dir)
    return curation.drop_set(r.where(F.col("text").contains("License")), r.where("flag = '1.0'"), r.where("flag = '-1.0'"), key="doc_id")


def drop_set_antijoin(spark, sf_dir):
    return curation.without(table(spark, sf_dir, "documents").select("doc_id", "lang"), _dropped(spark, sf_dir), "doc_id")


def balanced_per_class(spark, sf_dir):
    return sampling.balance(drop_set_antijoin(spark, sf_dir), "lang", 0, "doc_id")


def heldout_antijoin(spark, sf_dir):
    return curation.without(drop_set_antijoin(spark, sf_dir), balanced_per_class(spark, sf_dir), "doc_id")


def leakage_intersections(spark, sf_dir):
    rows = sampling.split_halves(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang", 0, "doc_id", 1)
    return curation.overlap(rows.where("part = 'select'"), rows.where("part = 'eval'"), "source")


def seeded_split(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    return pipelines.union_of({"select": a, "eval": b}, "part").select("id", "cls", "part")


def seeded_sample(spark, sf_dir):
    a, _ = halves(spark, sf_dir)
    return sampling.sample_n(a, SMALL, 3).select("id")


def weighted_sample(spark, sf_dir):
    a, _ = halves(spark, sf_dir)
    return sampling.sample_by_logit(a.withColumn("logit", F.col("x")[0]), SMALL, "logit", 3).select("id")


def path_resolve(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("files/"), F.col("page_id").cast("string"), F.lit(".html")).alias("relpath"))
    name = F.concat(F.col("page_id").cast("string"), F.lit(".html"))
    a = p.where(F.col("url").contains("/en/")).select(F.concat(F.lit("a/files/"), name).alias("path"))
    b = p.where(F.col("url").startswith("https")).select(F.concat(F.lit("b/"), name).alias("path"))
    return curation.resolve_paths(p.drop("url"), a.unionByName(b), ["a", "b/"]).select("page_id", "relpath", "found")


def cache_keys(spark, sf_dir):
    """The cache name of each class's vectors, its paths in order."""
    e = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    paths = e.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("paths"))
    return paths.select("lang", content_key("v1", "paths").alias("key"))


def _affinity(spark, sf_dir, **kernel):
    a, b = halves(spark, sf_dir)
    return pairs.kernel_means(a, b, **kernel).select("id", F.round("mean", 6).alias("affinity"))


def median_sigma(spark, sf_dir):
    return one(spark, sigma=round(setmetrics.median_sigma(halves(spark, sf_dir)[1]), 6))


def mmd2(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    return one(spark, **{k: round(v, 7) for k, v in setmetrics.mmd2(a, b).items()})


def kid_subsets(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    k = setmetrics.kid(b, a)
    return one(spark, kid=round(k["kid"], 7), kid_std=round(k["kid_std"], 7))


def nn_distance(spark, sf_dir):
    return setmetrics.to_reference(*halves(spark, sf_dir)).select("id", F.round("d", 6).alias("d"))


def copy_rate(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    r = setmetrics.copy_rate(b, a)
    return one(spark, copy_rate=r["copy_rate"], tau=r["tau"], candidate_median=r["candidate_median"], reference_median=r["reference_median"])


def memorisation_gate(spark, sf_dir):
    out, _ = gates.memorisation_gate(*halves(spark, sf_dir), 5)
    return out.select("id", F.round("d", 6).alias("d"), "keep")


def realism_gate(spark, sf_dir):
    out = gates.realism_gate(*halves(spark, sf_dir), 0.05, SIGMA)
    return out.select("id", F.round("affinity", 6).alias("affinity"), "keep")


def gate_report(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    _, r = gates.compose(a, {"memorisation": gates.memorisation_gate(a, b, 5)[0], "realism": gates.realism_gate(a, b, 0.05, SIGMA)})
    return one(spark, **r)


def chunk_quantile_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return gates.chunk_quantile_gate(rows, "score", "doc_id", 0.03, 2000).select("doc_id", "keep")


def coverage_density(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    r = setmetrics.coverage_density(b, a)
    return one(spark, coverage=r["coverage"], density=r["density"])


def generative_recall(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    return one(spark, recall=setmetrics.recall(b, a)["recall"])


def knn_rank_topk(spark, sf_dir):
    return selectors.top_scores(selectors.knn_rank(*halves(spark, sf_dir)), "score", SMALL, False).select("id", F.round("score", 6).alias("score"))


def score_topk(spark, sf_dir):
    a, _ = halves(spark, sf_dir)
    return selectors.top_scores(a.select("id", F.col("x")[0].alias("score")), "score", SMALL)


def herding_select(spark, sf_dir):
    return selectors.herding(*halves(spark, sf_dir), N).select("id", "pick_no")


def kcenter_select(spark, sf_dir):
    return selectors.kcenter(halves(spark, sf_dir)[0], N).select("id", "pick_no")


def dpp_select(spark, sf_dir):
    return selectors.dpp(halves(spark, sf_dir)[0], N, sigma=SIGMA)[0].select("id", "pick_no")


def gate_then_herd(spark, sf_dir):
    picks, _ = pipelines.gated_selection(*halves(spark, sf_dir), N, memorisation=5, realism=None)
    return picks.select("id", "pick_no")


def selector_ranking(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    kept = {"herding": selectors.herding(a, b, N), "k-center": selectors.kcenter(a, N), "random": sampling.sample_n(a, N, 3)}
    # N ids
    sets = {name: written(a.join(F.broadcast(ids.select("id")), "id", "left_semi")) for name, ids in kept.items()}
    measured = setmetrics.coverage_densities(b, sets)
    rows = [(name, s.count(), *(measured[name][m] for m in ("coverage", "density"))) for name, s in sets.items()]
    return report.ranked(spark.createDataFrame(rows, "name string, n long, coverage double, density double"), "coverage")


def auroc_confusion(spark, sf_dir):
    r = records(spark, sf_dir).where("quality is not null").withColumn("score", F.col("n_chars").cast("double"))
    out = models.binary_report(r, "score", "quality", 1000.0)
    return out.select(*(F.round(c, 9).alias(c) for c in ("auroc", "recall_pos", "recall_neg", "accuracy")), "tp", "fp", "fn", "tn")


def class_weights(spark, sf_dir):
    return models.class_weights(table(spark, sf_dir, "embeddings"), "label").select("label", "n", F.round("weight", 9).alias("weight"))


def _history(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("gen", F.year("o_orderdate"))
    return o.groupBy("gen").agg(F.count("*").alias("orders"), F.round(F.avg("o_totalprice"), 4).alias("price"))


def history_upsert(spark, sf_dir):
    old = _history(spark, sf_dir)
    late = table(spark, sf_dir, "orders").withColumn("gen", F.year("o_orderdate") + 2).groupBy("gen").agg(F.count("*").alias("orders"))
    merged = report.upsert_merge(old, late.withColumn("checked", F.lit(1)), "gen")
    return report.upsert_replace(merged, old.where("orders % 2 = 0").withColumn("checked", F.lit(2)), "gen")


def delta_vs_first(spark, sf_dir):
    out = report.delta_vs_first(_history(spark, sf_dir), "gen", ["orders", "price"])
    return out.select("gen", "orders_delta", F.round("price_delta", 4).alias("price_delta"))


def class_shares(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("ratio"))
    return report.class_summary(rows, "event_type", "ratio").select("event_type", *(F.round(c, 6).alias(c) for c in ("mean", "std", "over", "missing")), "n")


def mahalanobis_gate(spark, sf_dir):
    return gates.mahalanobis_gate(*halves(spark, sf_dir), 0.05, 20).select("id", F.round("d", 6).alias("d"), "keep")


def reference_threshold_gate(spark, sf_dir):
    return gates.reference_threshold_gate(*halves(spark, sf_dir), 95, 20).select("id", F.round("d", 6).alias("d"), "keep")


def class_threshold_gate(spark, sf_dir):
    """Each class of the pool by its own components and its own reference's distances."""
    out = gates.class_threshold_gate(*halves(spark, sf_dir), "cls", 95, 20)
    return out.select("id", "cls", F.round("d", 6).alias("d"), "keep")


def value_quantiles(spark, sf_dir):
    """Exact quantiles of the events' values, by type, many at once."""
    out = quantiles.quantiles(table(spark, sf_dir, "events"), "value", [0.01, 0.25, 0.5, 0.75, 0.99], ["event_type"])
    return out.select("event_type", "q", F.round("value", 6).alias("value"))


def frechet_distance(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    return one(spark, fd=round(setmetrics.frechet_distance(b, a), 4))


def vendi_score(spark, sf_dir):
    return one(spark, vendi=setmetrics.vendi_score(halves(spark, sf_dir)[0])["vendi"])


def vendi_rbf(spark, sf_dir):
    x = pairs.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return one(spark, **setmetrics.vendi_score(x, "rbf"))


def kmeans_balanced(spark, sf_dir):
    return models.kmeans_balanced(halves(spark, sf_dir)[0], SMALL, 8)


def two_sample_forest(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    return models.forest_rank(b, a)


def metric_map_explode(spark, sf_dir):
    """A row for each metric of each status's result document."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
    docs = o.select("o_orderstatus", F.to_json(F.struct("n", "first", "last")).alias("json"))
    return report.explode_metrics(docs, "json")


def nearest_then_herd(spark, sf_dir):
    return pipelines.nearest_then_herd(*halves(spark, sf_dir), N, k=20).select("id", "pick_no")


def compare_filters(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    return pipelines.compare_filters(b, a, methods=("maha", "knn"))


def herding_trace(spark, sf_dir):
    """How the distance of the picks to the reference falls."""
    picks = selectors.herding(*halves(spark, sf_dir), N)
    return selectors.logged(picks, 5, N).select("pick_no", F.round("mmd2", 7).alias("mmd2"))


def linear_probe(spark, sf_dir):
    a, b = (df.withColumn("y", (F.col("cls") < 5).cast("int")) for df in halves(spark, sf_dir))
    return models.linear_probe(a, b, steps=50).select("id", "y", F.round("p", 6).alias("p"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        label_map_counts, flag_bucket_report, last_flag_wins, drop_set_antijoin, balanced_per_class, heldout_antijoin, leakage_intersections, seeded_split, seeded_sample,
        weighted_sample, path_resolve, cache_keys, median_sigma, mmd2, kid_subsets, nn_distance, copy_rate, memorisation_gate, realism_gate, gate_report, chunk_quantile_gate,
        coverage_density, generative_recall, knn_rank_topk, score_topk, herding_select, kcenter_select, dpp_select, gate_then_herd, selector_ranking, auroc_confusion,
        class_weights, history_upsert, delta_vs_first, class_shares, mahalanobis_gate, reference_threshold_gate, frechet_distance, vendi_score, vendi_rbf, kmeans_balanced,
        two_sample_forest, linear_probe, metric_map_explode, nearest_then_herd, compare_filters, herding_trace,
        class_threshold_gate, value_quantiles,
    )
}
QUERIES["poly_affinity"] = lambda spark, sf_dir: _affinity(spark, sf_dir, name="poly")
QUERIES["rbf_affinity"] = lambda spark, sf_dir: _affinity(spark, sf_dir, name="rbf", sigma=SIGMA)

_RECORDS = """r AS (SELECT d.*, l.quality, l.toxic, CASE l.quality WHEN 1 THEN '1.0' WHEN 0 THEN '0.0' END AS label,
  CASE WHEN l.toxic = 1 THEN '1.0' WHEN l.quality = 0 THEN '-1.0' WHEN l.quality = 1 THEN '0.0' END AS flag
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
_KEPT = _RECORDS + """, k AS (SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r WHERE text LIKE '%License%' OR flag IN ('1.0', '-1.0'))),
bal AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id), doc_id) AS pos, (SELECT min(n) FROM (SELECT count(*) AS n FROM k GROUP BY lang)) AS size FROM k)"""
_HALVES = """h AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label AS cls, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || vec_id), vec_id) AS pos, count(*) OVER (PARTITION BY label) AS size FROM embeddings),
a AS (SELECT id, x, cls FROM h WHERE pos <= size // 2), b AS (SELECT id, x, cls FROM h WHERE pos > size // 2)"""
_SMALL = "f AS (SELECT * FROM a ORDER BY md5('3:' || id), id LIMIT {n})"
_POLY = "pow(list_dot_product(p.x, q.x) / len(p.x) + 1, 3)"
_RBF = "exp(-pow(list_distance(p.x, q.x), 2) / 2)"
_OWN = "own AS (SELECT p.id, min(list_distance(p.x, q.x)) AS d FROM b p JOIN b q ON p.id <> q.id GROUP BY p.id)"
_NN = "nn AS (SELECT p.id, min(list_distance(p.x, q.x)) AS d FROM a p, b q GROUP BY p.id)"
_AFF = f"aff AS (SELECT p.id, avg({_RBF}) AS affinity FROM a p, b q GROUP BY p.id)"


def _herd(pool: str, n: int, to: str = "hd") -> str:
    return f"""{to}0 AS (SELECT p.id, any_value(p.x) AS x, avg({_POLY}) AS a, any_value(pow(list_dot_product(p.x, p.x) / len(p.x) + 1, 3)) AS kxx FROM {pool} p, b q GROUP BY p.id),
{to}1 AS (SELECT 0 AS t, id, x, a, kxx, 0.0::DOUBLE AS b, NULL::INT AS pick_no FROM {to}0
  UNION ALL SELECT p.t + 1, p.id, p.x, p.a, p.kxx, p.b + {_POLY}, CASE WHEN p.id = q.id THEN p.t + 1 ELSE p.pick_no END
  FROM {to}1 p, (SELECT id, x FROM {to}1 WHERE pick_no IS NULL ORDER BY a - (b + 0.5 * kxx) / (t + 1) DESC, id LIMIT 1) q WHERE p.t < {n}),
{to} AS (SELECT id, pick_no FROM {to}1 WHERE t = {n} AND pick_no IS NOT NULL)"""


def _center(n: int) -> str:
    return f"""kc1 AS (SELECT 1 AS t, p.id, p.x, list_distance(p.x, q.x) AS d, CASE WHEN p.id = q.id THEN 1 END AS pick_no FROM a p, (SELECT id, x FROM a ORDER BY md5('0:' || id), id LIMIT 1) q
  UNION ALL SELECT p.t + 1, p.id, p.x, least(p.d, list_distance(p.x, q.x)), CASE WHEN p.id = q.id THEN p.t + 1 ELSE p.pick_no END
  FROM kc1 p, (SELECT id, x FROM kc1 WHERE pick_no IS NULL ORDER BY d DESC, id LIMIT 1) q WHERE p.t < {n}),
kc AS (SELECT id, pick_no FROM kc1 WHERE t = {n} AND pick_no IS NOT NULL)"""


_DPP = f"""dp1 AS (SELECT 0 AS t, id, x, 1.0::DOUBLE AS gain, []::DOUBLE[] AS col, NULL::INT AS pick_no FROM a
  UNION ALL SELECT t + 1, id, x, gain - e * e, list_append(col, e), CASE WHEN id = qid THEN t + 1 ELSE pick_no END
  FROM (SELECT p.*, q.id AS qid, ({_RBF} - CASE WHEN p.t = 0 THEN 0 ELSE list_dot_product(p.col, q.col) END) / sqrt(q.gain) AS e
    FROM dp1 p, (SELECT id, x, gain, col FROM dp1 WHERE pick_no IS NULL ORDER BY gain DESC, id LIMIT 1) q WHERE p.t < {N})),
dp AS (SELECT id, pick_no FROM dp1 WHERE t = {N} AND pick_no IS NOT NULL)"""


def _balls(ref: str) -> str:
    return f"""rad AS (SELECT id, any_value(x) AS x, max(d) AS radius FROM (SELECT p.id, p.x, list_distance(p.x, q.x) AS d, row_number() OVER (PARTITION BY p.id ORDER BY list_distance(p.x, q.x), q.id) AS rn FROM {ref} p JOIN {ref} q ON p.id <> q.id) WHERE rn <= 5 GROUP BY id)"""


def _cover(f: str) -> str:
    return f"(SELECT count(*) AS n FROM {f}) m, (SELECT avg((n > 0)::INT) AS c, sum(n) AS s FROM (SELECT p.id, count(q.id) AS n FROM rad p LEFT JOIN {f} q ON list_distance(p.x, q.x) <= p.radius GROUP BY p.id))"


SQL: dict[str, str] = {
    "label_map_counts": f"""WITH {_RECORDS}, u AS (SELECT 'strict' AS kind, *, CASE label WHEN '1.0' THEN 'good' WHEN '0.0' THEN 'normal' END AS cls FROM r UNION ALL SELECT 'loose', *, CASE label WHEN '1.0' THEN 'good' ELSE 'normal' END FROM r)
SELECT kind, lang, cls, count(*) AS n, count(DISTINCT source) AS subjects FROM u WHERE cls IS NOT NULL GROUP BY ALL""",
    "flag_bucket_report": f"""WITH {_RECORDS}, u AS (SELECT lang, CASE WHEN quality IS NULL THEN 'unmatched' WHEN flag = '1.0' THEN 'device' WHEN flag = '-1.0' THEN 'uncertain' WHEN flag = '0.0' THEN 'no_device' ELSE 'unmentioned' END AS bucket FROM r)
SELECT lang, bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6)::DOUBLE AS share FROM u GROUP BY lang, bucket""",
    "last_flag_wins": "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "drop_set_antijoin": f"WITH {_KEPT} SELECT doc_id, lang FROM k",
    "balanced_per_class": f"WITH {_KEPT} SELECT doc_id, lang FROM bal WHERE pos <= size",
    "heldout_antijoin": f"WITH {_KEPT} SELECT doc_id, lang FROM bal WHERE pos > size",
    "leakage_intersections": """WITH h AS (SELECT source, row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id), doc_id) <= count(*) OVER (PARTITION BY lang) // 2 AS s FROM documents)
SELECT DISTINCT source FROM h WHERE s INTERSECT SELECT source FROM h WHERE NOT s""",
    "seeded_split": f"WITH {_HALVES} SELECT id, cls, 'select' AS part FROM a UNION ALL SELECT id, cls, 'eval' FROM b",
    "seeded_sample": f"WITH {_HALVES}, {_SMALL.format(n=SMALL)} SELECT id FROM f",
    "weighted_sample": f"WITH {_HALVES} SELECT id FROM a ORDER BY -ln((('0x' || substr(md5('3:' || id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / exp(x[1] - (SELECT max(x[1]) FROM a)), id LIMIT {SMALL}",
    "path_resolve": "SELECT page_id, 'files/' || page_id || '.html' AS relpath, CASE WHEN url LIKE '%/en/%' THEN 'a/files/' || page_id || '.html' WHEN url LIKE 'https%' THEN 'b/' || page_id || '.html' END AS found FROM pages",
    "cache_keys": "SELECT lang, substr(sha1('v1' || chr(0) || string_agg(source, ',' ORDER BY source)), 1, 16) AS key FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang",
    "poly_affinity": f"WITH {_HALVES} SELECT p.id, round(avg({_POLY}), 6) AS affinity FROM a p, b q GROUP BY p.id",
    "rbf_affinity": f"WITH {_HALVES}, {_AFF} SELECT id, round(affinity, 6) AS affinity FROM aff",
    "median_sigma": f"WITH {_HALVES}, s AS (SELECT * FROM b ORDER BY md5('0:' || id), id LIMIT 2000) SELECT round(quantile_disc(list_distance(p.x, q.x), 0.5), 6) AS sigma FROM s p JOIN s q ON p.id < q.id",
    "mmd2": f"""WITH {_HALVES}, aa AS (SELECT avg({_POLY}) AS m, avg({_POLY}) FILTER (p.id <> q.id) AS u FROM a p, a q), bb AS (SELECT avg({_POLY}) AS m, avg({_POLY}) FILTER (p.id <> q.id) AS u FROM b p, b q), ab AS (SELECT avg({_POLY}) AS m FROM a p, b q)
SELECT round(aa.m + bb.m - 2 * ab.m, 7) AS biased, round(aa.u + bb.u - 2 * ab.m, 7) AS unbiased FROM aa, bb, ab""",
    "kid_subsets": f"""WITH {_HALVES}, s AS (SELECT unnest(range(100)) AS subset), z AS (SELECT least(1000, (SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS size),
f AS (SELECT subset, id, x FROM (SELECT subset, id, x, row_number() OVER (PARTITION BY subset ORDER BY md5('0f:' || subset || ':' || id), id) AS rn FROM a, s), z WHERE rn <= size),
g AS (SELECT subset, id, x FROM (SELECT subset, id, x, row_number() OVER (PARTITION BY subset ORDER BY md5('0r:' || subset || ':' || id), id) AS rn FROM b, s), z WHERE rn <= size),
ff AS (SELECT subset, avg({_POLY}) AS v FROM f p JOIN f q USING (subset) WHERE p.id <> q.id GROUP BY subset), gg AS (SELECT subset, avg({_POLY}) AS v FROM g p JOIN g q USING (subset) WHERE p.id <> q.id GROUP BY subset), fg AS (SELECT subset, avg({_POLY}) AS v FROM f p JOIN g q USING (subset) GROUP BY subset),
m AS (SELECT ff.v + gg.v - 2 * fg.v AS v FROM ff JOIN gg USING (subset) JOIN fg USING (subset))
SELECT round(avg(v), 7) AS kid, round(stddev_pop(v), 7) AS kid_std FROM m""",
    "nn_distance": f"WITH {_HALVES}, {_NN} SELECT id, round(d, 6) AS d FROM nn",
    "copy_rate": f"""WITH {_HALVES}, {_OWN}, {_NN}, t AS (SELECT quantile_cont(d, 0.05) AS tau, quantile_disc(d, 0.5) AS m FROM own)
SELECT round(avg((d < tau)::INT), 4) AS copy_rate, round(any_value(tau), 3) AS tau, round(quantile_disc(d, 0.5), 3) AS candidate_median, round(any_value(m), 3) AS reference_median FROM nn, t""",
    "memorisation_gate": f"WITH {_HALVES}, {_OWN}, {_NN} SELECT id, round(d, 6) AS d, d >= (SELECT quantile_cont(d, 0.05) FROM own) AS keep FROM nn",
    "realism_gate": f"WITH {_HALVES}, {_AFF} SELECT id, round(affinity, 6) AS affinity, affinity > (SELECT quantile_cont(affinity, 0.05) FROM aff) AS keep FROM aff",
    "gate_report": f"""WITH {_HALVES}, {_OWN}, {_NN}, {_AFF}, g AS (SELECT d >= (SELECT quantile_cont(d, 0.05) FROM own) AS m, affinity > (SELECT quantile_cont(affinity, 0.05) FROM aff) AS r FROM nn JOIN aff USING (id))
SELECT count(*)::DOUBLE AS n_in, count_if(m AND r)::DOUBLE AS n_kept, count_if(NOT m)::DOUBLE AS dropped_memorisation, count_if(NOT r)::DOUBLE AS dropped_realism FROM g""",
    "chunk_quantile_gate": "SELECT doc_id, n_chars::DOUBLE > quantile_cont(n_chars::DOUBLE, 0.03) OVER (PARTITION BY place // 2000) AS keep FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents)",
    "coverage_density": f"WITH {_HALVES}, {_balls('b')} SELECT round(c, 4) AS coverage, round(s / (5 * m.n), 4)::DOUBLE AS density FROM {_cover('a')}",
    "generative_recall": f"WITH {_HALVES}, {_balls('a')} SELECT round(avg(v), 4) AS recall FROM (SELECT q.id, max((list_distance(p.x, q.x) <= p.radius)::INT) AS v FROM rad p, b q GROUP BY q.id)",
    "knn_rank_topk": f"""WITH {_HALVES}, k AS (SELECT id, avg(d) AS score FROM (SELECT p.id, list_distance(p.x, q.x) AS d, row_number() OVER (PARTITION BY p.id ORDER BY list_distance(p.x, q.x), q.id) AS rn FROM a p, b q) WHERE rn <= 5 GROUP BY id)
SELECT id, round(score, 6) AS score FROM k ORDER BY k.score, id LIMIT {SMALL}""",
    "score_topk": f"WITH {_HALVES} SELECT id, x[1] AS score FROM a ORDER BY score DESC, id LIMIT {SMALL}",
    "herding_select": f"WITH RECURSIVE {_HALVES}, {_herd('a', N)} SELECT id, pick_no FROM hd",
    "kcenter_select": f"WITH RECURSIVE {_HALVES}, {_center(N)} SELECT id, pick_no FROM kc",
    "dpp_select": f"WITH RECURSIVE {_HALVES}, {_DPP} SELECT id, pick_no FROM dp",
    "gate_then_herd": f"WITH RECURSIVE {_HALVES}, {_OWN}, {_NN}, g AS (SELECT a.* FROM a JOIN nn USING (id) WHERE d >= (SELECT quantile_cont(d, 0.05) FROM own)), {_herd('g', N)} SELECT id, pick_no FROM hd",
    "selector_ranking": f"""WITH RECURSIVE {_HALVES}, {_herd('a', N)}, {_center(N)}, {_SMALL.format(n=N)}, {_balls('b')},
s1 AS (SELECT a.* FROM a JOIN hd USING (id)), s2 AS (SELECT a.* FROM a JOIN kc USING (id)),
u AS (SELECT 'herding' AS name, m.n, round(c, 4) AS coverage, round(s / (5 * m.n), 4)::DOUBLE AS density FROM {_cover('s1')} UNION ALL SELECT 'k-center', m.n, round(c, 4), round(s / (5 * m.n), 4)::DOUBLE FROM {_cover('s2')} UNION ALL SELECT 'random', m.n, round(c, 4), round(s / (5 * m.n), 4)::DOUBLE FROM {_cover('f')})
SELECT *, row_number() OVER (ORDER BY coverage DESC, name)::INT AS rank FROM u""",
    "auroc_confusion": f"""WITH {_RECORDS}, u AS (SELECT n_chars::DOUBLE AS s, quality AS y FROM r WHERE quality IS NOT NULL), k AS (SELECT s, y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM u),
t AS (SELECT sum(y) AS p, sum(1 - y) AS n, sum(rk) FILTER (y = 1) AS w, count_if(y = 1 AND s >= 1000) AS tp, count_if(y = 0 AND s >= 1000) AS fp FROM k)
SELECT round((w - p * (p + 1) / 2.0) / (p * n), 9)::DOUBLE AS auroc, round(tp / p, 9)::DOUBLE AS recall_pos, round((n - fp) / n, 9)::DOUBLE AS recall_neg, round((tp + n - fp) / (p + n), 9)::DOUBLE AS accuracy, tp::BIGINT AS tp, fp::BIGINT AS fp, (p - tp)::BIGINT AS fn, (n - fp)::BIGINT AS tn FROM t""",
    "class_weights": "SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (2.0 * count(*)), 9)::DOUBLE AS weight FROM embeddings GROUP BY label",
    "history_upsert": """WITH o AS (SELECT year(o_orderdate)::INT AS gen, count(*) AS orders, round(avg(o_totalprice), 4) AS price FROM orders GROUP BY 1), n AS (SELECT (year(o_orderdate) + 2)::INT AS gen, count(*) AS orders FROM orders GROUP BY 1),
m AS (SELECT coalesce(n.gen, o.gen) AS gen, coalesce(n.orders, o.orders) AS orders, price, CASE WHEN n.gen IS NOT NULL THEN 1 END AS checked FROM o FULL JOIN n ON o.gen = n.gen)
SELECT * FROM m WHERE gen NOT IN (SELECT gen FROM o WHERE orders % 2 = 0) UNION ALL SELECT gen, orders, price, 2 FROM o WHERE orders % 2 = 0""",
    "delta_vs_first": """WITH o AS (SELECT year(o_orderdate)::INT AS gen, count(*) AS orders, round(avg(o_totalprice), 4) AS price FROM orders GROUP BY 1)
SELECT gen, orders - first_value(orders) OVER (ORDER BY gen) AS orders_delta, round(price - first_value(price) OVER (ORDER BY gen), 4) AS price_delta FROM o""",
    "metric_map_explode": """WITH o AS (SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS f, max(o_orderkey) AS l FROM orders GROUP BY 1)
SELECT o_orderstatus, 'n' AS key, n::DOUBLE AS value FROM o UNION ALL SELECT o_orderstatus, 'first', f::DOUBLE FROM o UNION ALL SELECT o_orderstatus, 'last', l::DOUBLE FROM o""",
    "herding_trace": f"""WITH RECURSIVE {_HALVES}, {_herd('a', N)}, s AS (SELECT a.x, hd.pick_no AS p FROM a JOIN hd USING (id)),
t AS (SELECT unnest([5, {N}]) AS t), ss AS (SELECT t, avg({_POLY}) AS v FROM s p, s q, t WHERE p.p <= t AND q.p <= t GROUP BY t), sr AS (SELECT t, avg({_POLY}) AS v FROM s p, b q, t WHERE p.p <= t GROUP BY t), rr AS (SELECT avg({_POLY}) AS v FROM b p, b q)
SELECT ss.t::INT AS pick_no, round(ss.v + rr.v - 2 * sr.v, 7) AS mmd2 FROM ss JOIN sr USING (t), rr""",
    "value_quantiles": "SELECT event_type, q::DOUBLE AS q, round(value, 6) AS value FROM (SELECT event_type, unnest([0.01, 0.25, 0.5, 0.75, 0.99]) AS q, unnest(quantile_cont(value, [0.01, 0.25, 0.5, 0.75, 0.99])) AS value FROM events GROUP BY 1)",
    "class_shares": "SELECT event_type, round(avg(value / 100), 6) AS mean, round(stddev_pop(value / 100), 6) AS std, round(avg((value / 100 > 0.5)::INT), 6) AS over, round(avg((value IS NULL)::INT), 6) AS missing, count(*) AS n FROM events GROUP BY event_type",
}
