import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tests.llm.data import documents, empty

from winnow.llm import mixing, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1001])
def test_feistel_is_a_permutation_with_an_inverse(spark, n):
    size = F.lit(n).cast("long")
    rows = spark.range(n).select("id", sharding.feistel(F.col("id"), size, 3).alias("p")).withColumn("back", sharding.feistel(F.col("p"), size, 3, True)).collect()
    assert sorted(r["p"] for r in rows) == list(range(n))
    assert all(r["back"] == r["id"] for r in rows)


def test_grid_is_the_one_of_the_columns(spark):
    for n in (1, 2, 3, 4, 10, 99, 10**6, 10**12 + 1):
        a, b = sharding._grid(F.lit(n).cast("long"))
        assert tuple(spark.range(1).select(a.alias("a"), b.alias("b")).first()) == sharding.grid(n)


def test_shards_are_even_gapless_and_computable(spark):
    docs = documents(spark, extra=True)
    out = sharding.shard(docs, ["doc_id"], 5, seed=2)
    assert set(out.columns) == set(docs.columns)
    rows = out.collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(slots) == 5 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    ids = sorted((r["doc_id"] for r in rows if r["doc_id"] is not None)) + [None]
    for r in rows[:5]:
        assert ids[sharding.row_at(spark, r["shard"], r["slot"], 5, len(rows), 2)] == r["doc_id"]
    again = {(r["doc_id"], r["text"]): (r["shard"], r["slot"]) for r in sharding.shard(docs.repartition(3), ["doc_id"], 5, seed=2).collect() if r["doc_id"] != 105}
    assert all(again[r["doc_id"], r["text"]] == (r["shard"], r["slot"]) for r in rows if r["doc_id"] != 105)


def test_shard_edge_cases(spark):
    assert sharding.shard(empty(spark), ["doc_id"], 3).collect() == []
    one = sharding.shard(documents(spark).limit(1), ["doc_id"], 3).first()
    assert one["slot"] == 0
    with pytest.raises(ValueError):
        sharding.shard(empty(spark), ["doc_id"], 0)


def test_op1_sizes_and_checksums(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = sharding.op1_feistel_shards(spark, str(tmp_path)).collect()
    texts = defaultdict(list)
    for r in documents(spark).collect():
        texts[r["doc_id"]].append((r["text"] or "").encode())
    assert len(rows) == 48
    for r in rows:
        assert any(r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t) for t in texts[r["doc_id"]])


def by_hand(rows, weights=(5.0, 2.0, 1.0), epochs=3, seed=7):
    """Serve the queues one entry at a time."""
    import hashlib

    sources = sorted({r[1] for r in rows if r[1] is not None}) + [None] * any(r[1] is None for r in rows)
    h = lambda i: int(hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:15], 16)
    entries, budget = [], sum(r[2] for r in rows)
    for k, s in enumerate(sources):
        own = sorted(((h(r[0]), r[0] is None, r[0] or 0, r[2]) for r in rows if r[1] == s))
        size, served = sum(x[3] for x in own), 0
        for e in range(epochs):
            served = 0
            for x in own:
                served += x[3]
                if x[3]:
                    entries.append(((e * size + served) / weights[k % 3], k, e, *x[:3], s, x[3], None if x[1] else x[2]))
    taken, total = defaultdict(int), 0
    for e in sorted(entries, key=lambda e: e[:6]):
        total += e[7]
        if total > budget:
            break
        taken[e[6], e[8]] += e[7]
    return taken


def test_mix_equals_one_by_one_service(spark):
    docs = documents(spark, extra=True).withColumn("size", mixing.n_words(F.col("text")))
    rows = mixing.weighted_fair_mix(docs, "doc_id", "source", "size").collect()
    assert len(rows) == docs.count()
    plain = [(r["doc_id"], r["source"], r["size"]) for r in rows]
    want, got = by_hand(plain), defaultdict(int)
    for r in rows:
        assert 0 <= r["copies"] <= 3
        got[r["source"], r["doc_id"]] += r["copies"] * r["size"]
    assert {k: v for k, v in got.items() if v} == dict(want)
    assert abs(sum(t for t in {r["source"]: r["target"] for r in rows}.values()) - sum(p[2] for p in plain)) < 1e-6


def test_targets_stop_at_three_times_the_source(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 100), ("c", 100), (None, 0)], "src string, source_size long")
    rows = {r["src"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert rows["a"] == 3 and rows[None] == 0
    assert abs(rows["b"] - 198 * 2 / 3) < 1e-9 and abs(rows["c"] - 198 / 3) < 1e-9


def test_mix_edge_cases(spark):
    assert mixing.mix_documents(empty(spark)).collect() == []
    blank = documents(spark, [(1, None, "en", None, 0), (2, "", None, "x", 0)])
    assert mixing.mix_documents(blank).collect() == []
    docs = documents(spark, extra=True)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and 0 < out.count() <= 3 * docs.count()
