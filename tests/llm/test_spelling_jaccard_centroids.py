"""Spelling variants, Jaccard joins and centroids against plain Python."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm.data import documents, empty

from winnow.llm import centroids, jaccard_join, near_copies, simhash, spelling

# ---- spelling


def plain_counts(rows, every=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain_groups(counts):
    form, near = {}, {}
    for w, n in counts.items():
        found = [v for v in counts if v != w and abs(len(v) - len(w)) <= 1 and plain_distance(v, w) == 1]
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        near[w], form[w] = len(found), best if best and counts[best] >= 5 * n else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], near[w], counts[form[w]] if form[w] else None)
    return out


def test_words_are_counted_over_whole_texts_with_dropped_letters(spark):
    rng = random.Random(1)
    words = ["Èlevage", "hand×made", "straße", "WaTerIng", "waterin", "ÉÉÉÉÉÉ", "short", "ÿÿÿÿÿÿÿ", "日本語xxxxxx"]
    rows = [(i, " ".join(rng.choices(words, k=60)) + ".") for i in range(150)] + [(None, "strasse " * 700), (7, None), (8, ""), (9, "a" * 70_000), (9, "a" * 70_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for every in (199, 7, None):
        assert {r["word"]: r["n"] for r in spelling.vocabulary(df, every=every).collect()} == plain_counts(rows, every)


def test_spelling_groups_equal_brute_force(spark):
    rng = random.Random(2)
    words = {}
    for base in ("hammer", "Ünterwegs", "aaaaaa", "ababab", "water stone".replace(" ", "")):
        words[base] = rng.choice([5, 300, 4000])
        for _ in range(40):
            at = rng.randrange(len(base) + 1)
            changed = rng.choice([base[:at] + rng.choice("abéz𝒳") + base[at:], base[:at] + base[at + 1 :], base[:at] + rng.choice("abéz") + base[at + 1 :], base[::-1]])
            words[changed] = rng.choice([5, 5, 26, 60, 130])
            words[changed + "x"] = rng.choice([5, 25, 30])
    words |= {"x" * 3000: 40, "x" * 3001: 5, "x" * 1500 + "y" + "x" * 1499: 8}
    got = {r["word"]: tuple(r)[1:] for r in spelling.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long")).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = plain_groups({w: n for w, n in words.items() if len(w) < 100})
    assert {w: v for w, v in got.items() if len(w) < 100} == want
    assert any(v[0] and v[0] != v[1] for v in want.values())
    assert got["x" * 3001][:2] == ("x" * 3000,) * 2 and got["x" * 3000][3] == 2


def test_forms_lead_to_roots_over_long_chains(spark):
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(37)] + [("b", "36")], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(chain).collect()} == {**{str(i): "37" for i in range(37)}, "b": "37"}
    assert spelling.roots(chain.limit(0)).count() == 0


def test_distance_one_by_all_short_words():
    for a, b in itertools.product([*map("".join, itertools.chain.from_iterable(itertools.product("ab", repeat=n) for n in range(5)))], repeat=2):
        assert spelling.one_apart(a, b) == (plain_distance(a, b) == 1)
        if plain_distance(a, b) == 1:
            assert set(spelling.deletion_hashes(a).tolist()) & set(spelling.deletion_hashes(b).tolist())
    assert len(spelling.deletion_hashes("aab")) == 3 and len(spelling.deletion_hashes("")) == 1


def test_spelling_edges(spark):
    assert spelling.spelling_groups(spelling.vocabulary(empty(spark))).count() == 0
    a, b = (spelling.spelling_groups(spelling.vocabulary(documents(spark, extra=x))).collect() for x in (False, True))
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str) and len(a) > 10


# ---- Jaccard join


def shingles(text, size=3):
    words = re.findall("[^\\x20\\x09-\\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_join(rows, size=3, p=90):
    sets = [shingles(t, size) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= p * (len(sets[i]) + len(sets[j]) - shared):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (i, _), c in zip(rows, label):
        least[c] = min([x for x in (i, least.get(c)) if x is not None], default=None)
    return Counter((i, len(s), least[c]) for (i, _), s, c in zip(rows, sets, label))


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda n: f"w{rng.randrange(n)}"
    texts = []
    for length in (2, 3, 9, 40, 120):
        base = [word(400) for _ in range(length)]
        texts += [" ".join(base), " ".join(base).upper()]
        for changes in (1, 1, 2, 3, 6):
            copy = list(base)
            for at in rng.sample(range(length), min(changes, length)):
                copy[at] = word(400)
            texts.append(" ".join(copy))
            texts.append(" ".join(base + [word(400) for _ in range(changes)]))
    bank = [[word(40) for _ in range(12)] for _ in range(10)]
    texts += [" ".join(itertools.chain.from_iterable(rng.sample(bank, 8))) for _ in range(80)]
    return [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, " \t"), (None, texts[3]), (None, "alone here now"), (3, texts[3]), (503, "one"), (504, "ONE"), (505, "a\u00a0b c\x0bd e")]


@pytest.mark.parametrize("rounds", [1, 8])
def test_jaccard_groups_equal_all_pairs(spark, monkeypatch, rounds):
    rows = corpus()
    monkeypatch.setattr(jaccard_join, "WORTH", 0)
    monkeypatch.setattr(jaccard_join, "ROUNDS", max(1, rounds))
    monkeypatch.setattr(near_copies, "SAMPLE", 1 if rounds == 1 else 16)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in jaccard_join.jaccard_groups(df, "doc_id", "text").collect())
    assert got == plain_join(rows)


def test_groups_of_one_prefix_are_expanded(spark, monkeypatch):
    """Sets of one size and one prefix that are not all similar: what differs lies past the prefix."""
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    rng = random.Random(5)
    common = [f"c{i} c{i + 1} c{i + 2}" for i in range(0, 60, 3)]
    rows = []
    for i in range(60):  # a rare head that all of a family share, then lines that stand everywhere, some of them left out
        head = " ".join(f"f{i % 3}h{k}" for k in range(14))
        rows.append((i, head + " " + " ".join(rng.sample(common, 18))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for p, q in ((4, 5), (1, 2)):
        got = Counter(tuple(r) for r in jaccard_join.jaccard_groups(df, "doc_id", "text", 1, (p, q)).collect())
        assert got == plain_join(rows, 1, 100 * p // q)


def test_pairs_of_a_template_corpus_grow_with_the_rows(spark, monkeypatch):
    """Twice the texts of the same sentences make at most twice the pairs that are compared."""
    seen = []
    real = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *rest: seen.append(pairs.count()) or real(pairs, *rest))

    def compared(n):
        rng = random.Random(11)
        bank = [" ".join(f"v{rng.randrange(3000)}" for _ in range(14)) for _ in range(24)]
        rows = [(i, " ".join(rng.sample(bank, 8))) for i in range(n)]
        seen.clear()
        simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count()
        return sum(seen)

    few, more = compared(500), compared(1000)
    assert more <= 2.2 * few + 100, (few, more)


def test_jaccard_edges(spark):
    assert jaccard_join.jaccard_groups(empty(spark), "doc_id", "text").count() == 0
    a, b = (Counter(map(tuple, jaccard_join.jaccard_groups(documents(spark, extra=x), "doc_id", "text").collect())) for x in (False, True))
    assert a == b == plain_join([(r["doc_id"], r["text"]) for r in documents(spark).collect()])


# ---- centroids


def plain_clusters(rows, size, k, rounds, salt="3"):
    import hashlib

    kept = [(i, [int(np.floor(1024 * float(e))) for e in x]) for i, x in rows if x is not None and len(x) == size and all(e is not None and np.isfinite(e) for e in x)]
    first = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    m = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(m))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for c in range(len(m)):
            mine = [v for (_, v), a in zip(kept, at) if a == c]
            if mine:
                m[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return Counter((i, near(v)[1], near(v)[0]) for i, v in kept), m


def vectors(seed=4, n=300):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.gauss(rng.choice([-1, 0, 2]), 0.2))) for _ in range(6)]) for i in range(n)]
    rows += [(n, None), (n + 1, [1.0] * 5), (n + 2, [1.0] * 5 + [None]), (n + 3, [float("nan")] * 6), (n + 4, [float("inf")] + [0.0] * 5), (None, [0.5] * 6), (5, rows[5][1]), (5, [0.0] * 6)]
    return rows + [(n + 10 + i, [0.25] * 6) for i in range(60)]


@pytest.mark.parametrize("k", [1, 2, 8])
def test_clusters_equal_full_comparisons(spark, k):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, m = centroids.clusters(df, "vec_id", "embedding", 6, k, 10)
    want, centres = plain_clusters(rows, 6, k, 10)
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()) == want
    assert m.tolist() == centres


def test_bounds_spare_comparisons(spark):
    rng = random.Random(9)
    far = [[1000.0 * ((i >> j) & 1) for j in range(6)] for i in range(8)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in far[i % 8]]) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, _ = centroids.clusters(df, "vec_id", "embedding", 6, 8, 10)
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()) == plain_clusters(rows, 6, 8, 10)[0]
    assert sum(r["scans"] for r in found.collect()) < 0.5 * 11 * len(rows)


def test_cluster_edges(spark):
    few = spark.createDataFrame([(1, [0.5, 1e300]), (2, [0.0, -1e300])], "vec_id long, embedding array<double>")
    found, m = centroids.clusters(few, "vec_id", "embedding", 2, 8, 3)
    assert found.count() == 2 and len(m) == 2 and abs(m).max() == centroids.MOST and all(r["distance"] == 0 for r in found.collect())
    none, m = centroids.clusters(few.limit(0), "vec_id", "embedding", 2, 8, 3)
    assert none.count() == 0 and len(m) == 0
