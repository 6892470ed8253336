import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.data import LABELS, documents, empty, prose

import corpus_pipeline
from winnow.llm import quality, token_counts, toxicity
from winnow.llm._common import materialise
from winnow.llm.queries import QUERIES, SQL


def junk(i):
    return (prose(i, 6).upper() + "!! ") * 8 if i % 2 else " ".join(w + "%%%" for w in prose(i, 40).split())


def test_co_training_on_rows_it_has_not_seen(spark):
    rows = [(i, junk(i) if i % 5 == 0 else prose(i, 60), "en", "bad" if i % 5 == 0 else f"s{i % 3}", 300) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 400) if i % 3] + [(None, 0, 0), (1, None, 0)], LABELS)
    got = {r["doc_id"]: r for r in quality.score_quality(documents(spark, rows), labels).collect()}
    assert len(got) == 400
    unseen = [i for i in range(0, 400, 3)]
    assert sum((got[i]["score"] >= 0.5) == (i % 5 > 0) for i in unseen) >= 0.98 * len(unseen)
    assert sum((got[i]["meta_score"] >= 0.5) == (i % 5 > 0) for i in unseen) >= 0.9 * len(unseen)


def test_newton_passes_equal_a_plain_regression(spark):
    rng = np.random.default_rng(3)
    n = 300
    y = np.where(rng.random(n) < 0.5, rng.random(n) < 0.6, -1).astype(int)
    x = [np.where(rng.random((n, w)) < 0.1, rng.random((n, w)), 0).astype(np.float32) for w in (quality.TEXT_SIZE, quality.META_SIZE)]
    for v in x:
        v[:, 0] = (y == 1) * 2 - (y == 0) * 2 + rng.normal(size=n)
    rows = spark.createDataFrame([([float(a) for a in x[0][i]], [float(a) for a in x[1][i]], None if y[i] < 0 else int(y[i])) for i in range(n)], "text_x array<float>, meta_x array<float>, y int")
    got = quality.co_train(rows)

    one = [np.hstack([v.astype(float), np.ones((n, 1))]) for v in x]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    now, teachers = [np.zeros(v.shape[1]) for v in one], None
    for r in range(1 + quality.ROUNDS):
        for _ in range(quality.STEPS if r == 0 else 2):
            new = []
            for i in range(2):
                label, weight = y.astype(float), (y >= 0).astype(float)
                if teachers is not None:
                    p = sigmoid(one[1 - i] @ teachers[1 - i])
                    for j in range(n):
                        if y[j] < 0 and (p[j] >= quality.CONFIDENT or p[j] <= 1 - quality.CONFIDENT):
                            label[j], weight[j] = p[j] >= 0.5, quality.PSEUDO_WEIGHT
                p = sigmoid(one[i] @ now[i])
                pen = np.full(len(now[i]), quality.RIDGE)
                pen[-1] = 1e-3
                h = sum(weight[j] * p[j] * (1 - p[j]) * np.outer(one[i][j], one[i][j]) for j in range(n)) + np.diag(pen)
                g = sum(weight[j] * (label[j] - p[j]) * one[i][j] for j in range(n)) - pen * now[i]
                new.append(now[i] + np.clip(np.linalg.solve(h, g), -5, 5))
            now = new
        teachers = now
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(got, now))


def test_metadata_features_by_hand(spark):
    rows = [(1, "en", "s1", 9), (2, "en", None, None), (3, None, "s2", 0), (4, "de", "s1", 99), (5, "xx", "rare", 5)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long")
    assert quality.common_values(df, "lang", 2) == ["en", "de"]
    got = df.select("doc_id", quality.metadata_view(F.col("lang"), F.col("source"), F.col("n_chars"), ["en", "de"], ["s1"]).alias("x")).collect()
    for r in got:
        assert len(r["x"]) == quality.META_SIZE and sum(r["x"][3:]) == 2
    assert got[0]["x"][3] == 1 and got[3]["x"][4] == 1 and got[0]["x"][3 + quality.LANGS + quality.RARE] == 1


def test_quality_edge_cases(spark):
    none = spark.createDataFrame([], LABELS)
    rows = quality.score_quality(documents(spark, extra=True), none).collect()
    assert len(rows) == documents(spark).count() and {r["score"] for r in rows} == {0.5}
    assert quality.score_quality(empty(spark), none).collect() == []


def tokens(text):
    return {v: len(token_counts.encoder(f"test-{v}", token_counts.read_ranks(p)).encode_ordinary(text or "")) for v, p in token_counts.TOKENIZERS.items()}


def totals(state):
    out = {}
    for source, lang, text in state:
        for v, n in tokens(text).items():
            d, t = out.get((source, lang, v), (0, 0))
            out[source, lang, v] = (d + 1, t + n)
    return out


def test_rollup_follows_inserts_revisions_and_deletes(spark, tmp_path):
    kind = "doc_id long, op string, source string, lang string, text string, order int"
    batches = [
        [(1, "insert", "a", "en", "one two", 0), (2, "insert", "a", None, None, 0), (3, "insert", None, "de", "drei", 0), (None, "insert", "a", "en", "no id", 0), (3, "insert", None, "de", "drei", 0)],
        [(1, "revise", "b", "en", "one two three", 0), (9, "delete", None, None, None, 0), (3, "revise", "x", "x", "early", 1), (3, "delete", None, None, None, 2), (5, "revise", "c", "fr", "cinq", 0)],
        [],
    ]
    states = [{1: ("a", "en", "one two"), 2: ("a", None, None), 3: (None, "de", "drei"), None: ("a", "en", "no id")}, {1: ("b", "en", "one two three"), 2: ("a", None, None), 5: ("c", "fr", "cinq"), None: ("a", "en", "no id")}]
    states.append(states[1])
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    assert rollup.totals().collect() == []
    for b, (rows, state) in enumerate(zip(batches, states)):
        changes = spark.createDataFrame(rows, kind)
        assert rollup.apply(b, changes)
        assert not rollup.apply(b, changes)
        got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}
        assert got == totals(state.values())


def test_rows_without_an_id_can_only_be_inserted(spark, tmp_path):
    kind = "doc_id long, op string, source string, lang string, text string, Order int, extra string"
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    rollup.apply(0, spark.createDataFrame([(None, "insert", "s", "en", "a b", 0, "x"), (None, "insert", "s", "en", "a b", 0, "x"), (1, "insert", "s", "en", "a\na", 0, "x"), (1, "other", "z", "z", "z", 9, "x")], kind))
    rollup.apply(1, spark.createDataFrame([(None, "revise", "s", "en", "a b c", 0, "x"), (None, "delete", None, None, None, 0, "x")], kind))
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}
    assert got == totals([("s", "en", "a b"), ("s", "en", "a b"), ("s", "en", "a\na")])


def test_a_very_long_word_is_counted(spark, tmp_path):
    import time

    begin = time.time()
    assert all(n > 0 for n in tokens("ab" * 200_000).values())
    assert time.time() - begin < 60


def test_a_batch_that_broke_off_is_written_anew(spark, tmp_path):
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    kind = "doc_id long, op string, source string, lang string, text string"
    materialise(spark.createDataFrame([(1, "s", "en", "byte_bpe_50k", 1, 99)], "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"), f"file://{tmp_path}/rollup/ledger/1")
    assert rollup.totals().collect() == []
    rollup.apply(1, spark.createDataFrame([(1, "insert", "s", "en", "one")], kind))
    assert {r["n_tokens"] for r in rollup.totals().collect()} <= set(tokens("one").values())


def test_generations_keep_totals_and_what_can_be_replaced(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "GENERATION", 2)
    root = f"file://{tmp_path}/rollup"
    kind = "doc_id long, op string, source string, lang string, text string"
    state: dict = {}
    for b in range(5):
        rows = [(b, "insert", "a", "en", f"new {b}"), (None, "insert", "n", None, "no id")] + ([(b - 1, "revise", "b", "en", "one " * b), (b - 2, "delete", None, None, None)] if b > 1 else [])
        rollup = token_counts.Rollup(spark, root)
        rollup.apply(b, spark.createDataFrame(rows, kind))
        state |= {b: ("a", "en", f"new {b}"), f"n{b}": ("n", None, "no id")}
        if b > 1:
            state[b - 1] = ("b", "en", "one " * b)
            state.pop(b - 2)
        # a generation that broke off has no marker and is not read
        materialise(spark.createDataFrame([("z", "z", "z", 9, 9)], token_counts.DELTAS), f"{root}/generations/99/deltas")
        got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}
        assert got == totals(state.values())
    assert rollup._generation()[1] == {0, 1, 2}
    assert not (tmp_path / "rollup/ledger/0").exists() and (tmp_path / "rollup/ledger/4").exists()
    before = sorted(rollup.totals().collect())
    assert rollup.compact() and not rollup.compact()
    assert sorted(rollup.totals().collect()) == before
    assert not rollup.apply(0, spark.createDataFrame([(50, "insert", "a", "en", "again")], kind))
    assert sorted(token_counts.Rollup(spark, root).totals().collect()) == before


def test_op8_totals(spark, tmp_path):
    rows = [(1, "a\nb\na", "en", "s", 1), (2, "same text", "en", "s", 1), (3, "same text", "en", "t", 1), (4, None, None, None, None), (5, "x\n\n\ny", "de", "t", 1)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in token_counts.op8_token_rollup(spark, str(tmp_path)).collect()}
    assert got == totals([("s", "en", "a\nb"), ("s", "en", "same text"), (None, None, None), ("t", "de", "x\n\ny")])


@pytest.fixture
def corpus(spark, tmp_path):
    rows = [(i, prose(i, 60) + (" vilescum gitwurm vilescum" if i % 4 == 0 else ""), "en", f"s{i % 3}", 1) for i in range(240)]
    rows += [(1000 + i, rows[i][1], "en", "s0", 1) for i in range(5)] + [(2000, None, None, None, None)]
    rows += [(3000, "start " + prose(777, 40) + " end", "en", "s1", 1), (3001, prose(3001, 60), "en", "s1", 1)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(777, 40))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows


def test_pipeline_stage_by_stage(spark, corpus):
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialise(stage(spark, docs, path))
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        seen.append((name, ids))
        assert docs.columns[: len(columns)] == columns and (len(docs.columns) == len(columns) or k == 4)
    ids = dict(seen)
    held_out = lambda i: __import__("zlib").crc32(str(i).encode()) % 5 == 0
    assert not {i for i in range(0, 240, 4) if held_out(i)} & set(ids["toxicity"])
    assert {i for i in range(240) if i % 4} | {2000, 3000, 3001} <= set(ids["toxicity"])
    assert not {1001, 1002, 1003} & set(ids["near_duplicates"])
    assert {i for i in range(240) if i % 4} | {3000, 3001} <= set(ids["near_duplicates"])
    assert set(ids["near_duplicates"]) - set(ids["decontaminate"]) == {3000}
    assert set(ids["mix"]) <= set(ids["decontaminate"]) and max(map(ids["mix"].count, ids["mix"])) <= 3
    assert sorted(map(str, ids["mix"])) == sorted(map(str, ids["shards"]))
    assert corpus_pipeline.run(spark, path).count() == len(ids["shards"])


def test_stages_stand_nulls_repeats_clashing_names_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)] + [(None, None, None)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, None), (1, ""), (2, prose(777, 40))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark, extra=True)
    own = docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(prose(4321, 50))})
    docs = materialise(docs.unionByName(own))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0
        out = materialise(stage(spark, docs, str(tmp_path)))
        assert out.columns[: len(docs.columns)] == docs.columns if k < 4 else {"shard", "slot"} <= set(out.columns)
        docs = out if k < 3 else docs
    # of two rows without an id one is a near copy of document 9; texts without words are one group
    assert docs.where("doc_id is null").count() == 1 and docs.where("text is null or not text rlike '[a-z]'").count() == 1
    assert docs.where("doc_id = 105").count() <= 1


def test_counts_stand_clashing_names_and_repeated_rows(spark):
    from winnow.llm import quality_rules

    docs = documents(spark, extra=True).withColumns({c: F.lit(1) for c in ("g", "m", "symbol", "low", "kept")})
    got = quality_rules.judge(docs.drop("id")).collect()
    assert len(got) == docs.count() and sum(r["id"] == 105 for r in got) == 2
    mixed = __import__("winnow.llm.mixing", fromlist=["x"]).weighted_fair_mix(docs.withColumns({"Target": F.lit("own"), "size": F.lit(3)}).drop("target"), "doc_id", "source", "size")
    assert mixed.columns.count("target") == 1 and mixed.select("target").dtypes[0][1] == "double"


def test_every_operator_has_a_query():
    assert {int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op")} == set(range(1, 11))
    assert set(SQL) <= set(QUERIES)


def test_fold_is_crc32_of_the_id(spark):
    import zlib

    for r in spark.range(50).select("id", toxicity.fold(F.col("id")).alias("f")).collect():
        assert r["f"] == zlib.crc32(str(r["id"]).encode()) % 5


def test_order_hash_is_the_md5_prefix(spark):
    got = spark.range(3).select(F.conv(F.substring(F.md5(F.concat(F.lit("7:"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long").alias("h")).collect()
    assert [r["h"] for r in got] == [int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:15], 16) for i in range(3)]
