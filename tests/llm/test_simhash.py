import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.data import documents, empty, prose

from winnow.llm import components as stars
from winnow.llm import near_copies, simhash
from winnow.llm.components import connected_components


def by_hand(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits=2):
    """Smallest id for each row of (id, fp), null last."""
    rows, label = fps, list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(rows[i][1] ^ rows[j][1]).count("1") <= bits and label[j] < label[i]:
                    label[i], changed = label[j], True
    ids = defaultdict(list)
    for (i, _), k in zip(rows, label):
        ids[k].append(i)
    return [min((x for x in ids[k] if x is not None), default=None) for k in label]


def test_fingerprints_and_groups_match_brute_force(spark, tmp_path):
    documents(spark, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    texts = documents(spark).collect()
    rows = simhash.op3_simhash_groups(spark, str(tmp_path)).collect()
    want = [(r["doc_id"], by_hand(r["text"])) for r in texts]
    comps = components(want)
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows) == sorted((str(i), f"{f:016x}", str(c)) for (i, f), c in zip(want, comps))


def test_links_lose_nothing(spark):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, 1, (1 << 64) - 1, (1 << 63) | 1}
    for f in list(fps)[:50]:
        g = f
        for _ in range(rng.randint(1, 4)):  # chains of near fingerprints
            for b in rng.sample(range(64), rng.randint(1, 3)):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r["fp"], r["other"]) for r in simhash.linked_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert got == want and len(want) > 40


@pytest.mark.parametrize("split", [0, stars.SPLIT])
def test_components_of_paths_stars_and_loops(spark, monkeypatch, split):
    monkeypatch.setattr(stars, "SPLIT", split)
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 130)] + [(200, 200), (None, 5), (301, 300), (300, 301)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 130)}, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_keep_one(spark):
    docs = documents(spark, extra=True)
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    prints = [by_hand(r["text"]) for r in kept]
    assert len(set(prints)) == len(prints)
    all_prints = {by_hand(r["text"]) for r in docs.collect()}
    assert all(any(bin(f ^ g).count("1") <= 2 for g in prints) for f in all_prints)
    assert [r["doc_id"] for r in kept if by_hand(r["text"]) == 0] == [100]
    assert simhash.keep_one(empty(spark)).collect() == []


def test_keep_one_starts_from_near_fingerprints(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    other = [*words[:200], "new", *words[200:]]  # one word more
    half = [*words[:300], *(f"x{i}" for i in range(300))]  # not similar
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(half)), (4, " ".join(words)), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.select(F.col("doc_id").alias("t"), "text")
    prints = {t: simhash.fingerprint((x or "").encode(), 5) for t, x in rows}
    apart = lambda a, b: bin(prints[a] ^ prints[b]).count("1")
    bits = max(1, apart(1, 2))
    near = {(r["a"], r["b"]) for r in simhash.near_texts(texts, bits).collect()}
    first = {f: min(t for t in prints if prints[t] == f) for f in prints.values()}
    want = {(first[f], t) for t, f in prints.items() if first[f] != t}
    want |= {tuple(sorted((a, b))) for a in first.values() for b in first.values() if a != b and apart(a, b) <= bits}
    assert {tuple(sorted(p)) for p in near} == want and {(1, 2), (1, 4), (5, 6)} <= want
    asked = []
    all_pairs = lambda texts: asked.append(1) or texts.select(F.col("t").alias("a")).crossJoin(texts.select(F.col("t").alias("b")))
    monkeypatch.setattr(simhash, "near_texts", all_pairs)  # what is not similar stays apart
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [1, 3, 5] and asked == [1]


def test_keep_one_shuffles_copies_only(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)), i % 3) for i in range(60)]
    copies = [(100, rows[7][1], 1), (101, rows[7][1] + " more", 1), rows[9], (None, rows[11][1], 2), (None, rows[11][1], 2)]
    docs = spark.createDataFrame(rows + copies + [(None, "alone here", 0), (None, None, 0), (None, "", 0)], "doc_id long, text string, Group int")
    plain, met = type(docs).dropDuplicates, []
    monkeypatch.setattr(type(docs), "dropDuplicates", lambda self, *a: met.append(self.count()) or plain(self, *a))
    want = sorted([*map(tuple, rows), (None, "alone here", 0)], key=str)
    got = lambda: sorted((tuple(r) for r in simhash.keep_one(docs).collect() if r["text"]), key=str)
    assert got() == want and met and met[0] <= 6  # of 62 rows that stay
    monkeypatch.setattr(near_copies, "SLOTS", 8)  # many share a slot with a copy
    assert got() == want and met[1] > 6 >= met[0]


def test_whole_sets_of_a_batch_come_in_slices(spark, monkeypatch):
    texts = [prose(i, 40) for i in range(50)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "t long, text string").coalesce(1)
    whole = docs.select("t", near_copies.whole_sets(5)("text").alias("x")).collect()
    monkeypatch.setattr(near_copies, "SLICE", 1 << 10)
    assert docs.select("t", near_copies.whole_sets(5)("text").alias("x")).collect() == whole and len(whole) == 52
    parts = list(near_copies.whole_sets(5).func(iter([pa.array(texts)])))
    assert len(parts) > 5 and sum(map(len, parts)) == 52


def test_long_text_and_chunks(monkeypatch):
    text = prose(1, 500).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole == by_hand(text.decode())


def test_extreme_fingerprint_distances(spark):
    row = spark.range(1).select(F.lit(-1).cast("long").alias("fp")).select(simhash.distance(F.col("fp"), 0).alias("a"), simhash.distance(F.col("fp"), (1 << 64) - 1).alias("b"), simhash.distance(F.col("fp"), 0, ((1 << 4) - 1) << 60).alias("c")).first()
    assert tuple(row) == (64, 0, 4)


def plan_of(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_links_have_a_small_plan(spark):
    assert len(plan_of(simhash.linked_fingerprints(spark.createDataFrame([(1,), (3,)], "fp long")))) < 20_000  # 37,000 with an expression for each pivot


def test_rounds_of_components_read_their_links_six_times(spark, monkeypatch):
    reads, write = [], stars.materialise
    monkeypatch.setattr(stars, "materialise", lambda df: reads.append(plan_of(df).count("Relation [")) or write(df))
    got = connected_components(spark.createDataFrame([(5, 4), (3, 4), (9, 8)], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8}
    assert 0 < max(reads) <= 6
