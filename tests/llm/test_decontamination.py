import random
import time

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.data import documents, empty, prose

from winnow.llm import decontamination as D
from winnow.llm._text import plain


def text_of(codes):
    return "".join(chr(c) if c else " " for c in codes)


def edits(item, text):
    """The fewest edits between ``item`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            new[j] = min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


ITEMS = [(i, prose(100 + i, n)) for i, n in enumerate((14, 20, 30, 45))] + [(10, "Élan, Über-Weg 7; naïve café résumé déjà vu."), (11, "Yes."), (12, None), (13, "!!!"), (14, "tiny item")]


@pytest.mark.parametrize("seed", range(6))
def test_hits_are_those_of_the_full_edit_table(seed):
    rng, index = random.Random(seed), D.Index.of(ITEMS)
    for _ in range(12):
        x = rng.choice([i for i in index.items if len(i.chars) >= 40])
        s = list(text_of(x.chars))
        for _ in range(rng.randint(0, x.edits + 4)):
            at, kind = rng.randrange(len(s)), rng.random()
            if kind < 0.3:
                s[at] = rng.choice("abc xyz")
            elif kind < 0.6:
                s.insert(at, rng.choice("abc xyz"))
            else:
                s.pop(at)
        text = prose(rng.randint(0, 999), 20) + ". " + "".join(s).upper() + " -- " + prose(rng.randint(0, 999), 15)
        found = {h[0]: h for h in D.find(index, plain(pa.array([prose(1, 9), text])))[1]}
        for y in index.items:
            if not y.q:
                continue
            least = edits(text_of(y.chars), text_of(D.normal(text)))
            assert (least <= y.edits) == (y.id in found)
            if y.id in found:
                assert found[y.id][3] == least
                part = text_of(D.normal(text[found[y.id][1] : found[y.id][2]]))
                assert edits(text_of(y.chars), part) == least


def test_items_of_all_lengths_get_a_tenth_of_edits(monkeypatch):
    monkeypatch.setattr(D, "PLACES", 64)  # many parts
    rng = random.Random(5)
    items = [(n, prose(n, 40)[:n].rstrip(" .,") + "x" * (n - len(prose(n, 40)[:n].rstrip(" .,")))) for n in range(15, 81)]
    index = D.Index.of(items)
    assert all(x.q and x.edits == len(x.chars) // 10 and x.least >= D.LEAST for x in index.items if len(x.chars) >= D.SHORT)
    for x in index.items:
        if not x.q:
            continue
        s = list(text_of(x.chars))
        for _ in range(x.edits + rng.randint(0, 1)):
            at, kind = rng.randrange(len(s)), rng.random()
            s[at : at + 1] = [] if kind < 0.3 else [rng.choice("qzj"), s[at]] if kind < 0.6 else [rng.choice("qzj")]
        text = prose(rng.randint(0, 999), 12) + ". " + "".join(s) + " -- " + prose(rng.randint(0, 999), 8)
        found = {h[0]: h[3] for h in D.find(index, plain(pa.array([prose(1, 9), text])))[1]}
        for y in index.items:
            if y.q:
                least = edits(text_of(y.chars), text_of(D.normal(text)))
                assert found.get(y.id) == (least if least <= y.edits else None)


def test_many_short_items_cost_little_and_match_as_whole_words():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(60_000))
    items = [(i, "".join(rng.choice("abcdefgh  ") for _ in range(rng.randint(3, 12)))) for i in range(50_000)]
    index, few = D.Index.of(items), D.Index.of(items[:1])
    texts = plain(pa.array([text, text[:5000], ""]))
    times = []
    for one in (few, few, index):
        began = time.perf_counter()
        hits = D.find(one, texts)
        times.append(time.perf_counter() - began)
    assert times[2] < 2 * times[1] + 1  # a second for the 20,000 hits
    padded = f" {text[:5000]} "
    assert {h[0] for h in hits[1]} == {i for i, t in items if t.split() and f" {' '.join(t.split())} " in padded}


def test_a_very_long_text_is_searched_whole():
    item = prose(77, 30)
    text = prose(1, 400_000) + ". " + item
    index = D.Index.of([(1, item), (2, "tiny item")])
    (hits,) = D.find(index, plain(pa.array([text + " tiny item"])))
    assert [(h[0], h[3]) for h in hits] == [(1, 0), (2, 0)]


def test_places_in_the_original_text():
    index = D.Index.of(ITEMS)
    text = "Before: " + ITEMS[10 - 6][1].replace(" ", "  ").upper() + " after"
    (hit,) = D.find(index, plain(pa.array([text])))[0]
    assert hit[0] == 10 and text[hit[1] : hit[2]].startswith("ÉLAN") and hit[3] == 0


def test_short_items_match_as_whole_words():
    index = D.Index.of(ITEMS)
    hits = D.find(index, plain(pa.array(["oh yes", "yesterday", "a tiny   item!", "tiny items", "", None], pa.string())))
    assert [[h[0] for h in x] for x in hits] == [[11], [], [14], [], [], []]


def test_band_alignment_keeps_the_first_and_cheapest():
    a = np.frombuffer("abcdefghij".encode("utf-32-le"), np.uint32)
    region = np.frombuffer("xxabcdXfghijyy".encode("utf-32-le"), np.uint32)
    assert D.align(a, region, 2, 6) == (1, 2, 12)
    assert D.align(a, region[:4], 2, 6) is None


def test_clean_and_edge_cases(spark, tmp_path):
    docs = documents(spark, extra=True)
    bench = spark.createDataFrame([(1, prose(3, 33)), (2, None), (2, "")], "item_id long, text string")
    out = D.clean(docs, bench)
    assert out.columns == docs.columns
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in out.collect()}
    assert gone == {3, 103}
    assert D.clean(empty(spark), bench).collect() == []
    assert D.clean(docs, bench.limit(0)).count() == docs.count()
    docs.drop("hits").write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = D.op2_contaminated(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in rows) == [(3, 1, 0), (103, 1, 0)]


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_ITEMS", 2)
    docs = documents(spark).limit(6)
    bench = spark.createDataFrame([(i, prose(i, 30 + i)) for i in range(5)], "item_id long, text string")
    rows = D.with_hits(docs, bench).select("doc_id", "hits.item_id").collect()
    assert all(r["item_id"] == ([r["doc_id"]] if r["doc_id"] < 5 else []) for r in rows)
