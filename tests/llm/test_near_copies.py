"""Near copies against all pairs compared by hand."""

import random

from tests.llm.data import WORDS

from winnow.llm import near_copies, simhash


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def planted():
    """Texts of rare and of common words, near copies at all distances, and texts that share a long passage."""
    rng = random.Random(7)
    word = lambda: rng.choice(WORDS) + str(rng.randrange(200))
    texts, passage = [], [word() for _ in range(60)]
    for _ in range(30):
        base = [word() for _ in range(rng.choice([4, 12, 60, 200]))]
        texts.append(base)
        for changes in (1, 2, 3, 5, 8):
            copy = list(base)
            for at in rng.sample(range(len(base)), min(changes, len(base))):
                copy[at] = word()
            texts.append(copy)
    texts += [passage + [word() for _ in range(rng.randrange(25))] for _ in range(80)]
    texts += [texts[0], [w.upper() for w in texts[0]]]
    return [" ".join(t) for t in texts]


def by_hand(texts):
    sets, label = [shingle_set(t) for t in texts], list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label, links


def test_keep_one_removes_near_copies_and_no_others(spark, monkeypatch):
    texts = planted()
    label, links = by_hand(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(set(label))
    assert len(links) > 60 and 40 < len(want) < len(texts) - 60
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == want
    monkeypatch.setattr(near_copies, "SAMPLE", 1)  # all shingles that recur come last
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == want


def test_fingerprints_take_a_shingle_length(spark):
    text = planted()[1]
    row = spark.createDataFrame([(text,)], "text string").select(simhash.simhash64("text").alias("a"), simhash.simhash64("text", 5).alias("b")).first()
    assert [x & (1 << 64) - 1 for x in row] == [simhash.fingerprint(text.lower().encode(), n) for n in (3, 5)] and row[0] != row[1]
