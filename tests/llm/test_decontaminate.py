import math
import random
from itertools import combinations

import pytest
from newsloom.llm import decontaminate as D

from .fixtures import documents, empty, messy, words


def brute(docs, items):
    out = set()
    keyed = {}
    for i, t in items:
        w = tuple(words(t))
        if w:
            keyed[w] = min(i, keyed.get(w, i))
    for doc, t in docs:
        w = words(t)
        for item, i in keyed.items():
            width = min(D.WINDOW, len(item))
            for start in range(-len(item), len(w)):
                eq = [w[start + q] == x for q, x in enumerate(item) if 0 <= start + q < len(w)]
                if len(eq) >= width and max(sum(eq[k:k + width]) for k in range(len(eq) - width + 1)) >= math.ceil(
                        width * D.MIN_MATCH):
                    out.add((doc, i))
                    break
    return out


def make(seed=1):
    rng = random.Random(seed)
    v = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(v) for _ in range(n))) for i, n in enumerate([5, 6, 7, 8, 12, 13, 20, 40, 60, 13])]
    items += [(50, items[6][1]), (51, None), (52, "too short"), (53, "")]
    docs = []
    for k in range(120):
        body = [rng.choice(v) for _ in range(rng.randint(0, 80))]
        if k % 2:
            item = words(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 2, len(item) // 6])):
                if item:
                    item[rng.randrange(len(item))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = item[rng.choice([0, 0, 3]):]
        docs.append((k, " ".join(body)))
    return docs, items


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, words string, start int")


def test_masks_survive_two_substitutions():
    offsets = [[s + k for k, c in enumerate(m) if c == "1"] for m in D.MASKS for s in range(D.WINDOW - len(m) + 1)]
    for bad in combinations(range(D.WINDOW), 2):
        assert any(not set(bad) & set(o) for o in offsets)


@pytest.mark.parametrize("seeds", [D.BROADCAST_SEEDS, 0])
def test_against_brute_force(spark, seeds):
    """Both the broadcast and the shuffled join; items below the mask's span need all their words."""
    docs, items = make()
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(documents(spark, docs), benchmark(spark, items),
                                                       broadcast_seeds=seeds).collect()}
    want = brute(docs, items)
    long_enough = {i for i, t in items if len(words(t)) >= D.WINDOW}
    assert {x for x in got if x[1] in long_enough} == {x for x in want if x[1] in long_enough}
    assert got <= want


def test_short_masks_survive_every_allowed_substitution():
    for n in range(1, D.WINDOW + 1):
        masks = D.MASKS if n >= D.LONG_ITEM else D.SHORT_MASKS[n]
        offsets = [[s + k for k, c in enumerate(m) if c == "1"] for m in masks for s in range(n - len(m) + 1)]
        for bad in combinations(range(n), n - math.ceil(n * D.MIN_MATCH)):
            assert any(not set(bad) & set(o) for o in offsets), (n, bad)


@pytest.mark.parametrize("seeds", [D.BROADCAST_SEEDS, 0])
def test_short_items_against_brute_force(spark, seeds):
    """Every allowed substitution of an item of 5 to 13 words, and one substitution too many."""
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(1, D.WINDOW + 1)]
    docs = []
    for n, text in items:
        allowed = n - math.ceil(n * D.MIN_MATCH)
        for bad in [*combinations(range(n), allowed), *combinations(range(n), allowed + 1)]:
            changed = ["changed" if k in bad else w for k, w in enumerate(words(text))]
            docs += [(len(docs), " ".join(changed)), (len(docs) + 1, " ".join(["before", *changed, "after"]))]
    docs += [(len(docs), " ".join(w for _, t in items for w in words(t)[1:]))]
    found = D.find_leaks(documents(spark, docs), benchmark(spark, items), broadcast_seeds=seeds).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute(docs, items)
    random_docs, random_items = make(5)
    found = D.find_leaks(documents(spark, random_docs), benchmark(spark, random_items), broadcast_seeds=seeds).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute(random_docs, random_items)


def test_keep_clean(spark):
    docs, items = make(3)
    df = documents(spark, docs + [(900, None), (901, ""), (None, "nothing here")])
    leaks = {r.doc_id for r in D.find_leaks(df, benchmark(spark, items)).collect()}
    out = D.keep_clean(df, benchmark(spark, items))
    assert out.columns == df.columns
    assert leaks
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(
        r.doc_id for r in df.collect() if r.doc_id is not None and r.doc_id not in leaks)
    assert any(r.doc_id is None for r in out.collect())


def test_empty_tables(spark):
    docs, items = make()
    assert D.find_leaks(empty(spark), benchmark(spark, items)).collect() == []
    assert D.find_leaks(documents(spark, docs), benchmark(spark, [])).collect() == []
    assert D.find_leaks(messy(spark), benchmark(spark, items)).collect() == []
