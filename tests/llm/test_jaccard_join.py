import random
from collections import defaultdict

import pytest
from newsloom.llm import jaccard_join as J

from .fixtures import documents, empty, messy, words


def brute(texts, threshold=0.8):
    nodes = defaultdict(list)
    out = {}
    for k, (i, t) in enumerate(texts):
        w = tuple(words(t))
        if w:
            nodes[w].append(i)
    keys = list(nodes)
    sets = [{w[k:k + 5] for k in range(max(1, len(w) - 4))} for w in keys]
    parent, links = list(range(len(keys))), [0] * len(keys)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c >= threshold * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    smallest = defaultdict(lambda: 1 << 60)
    for a, k in enumerate(keys):
        smallest[find(a)] = min([smallest[find(a)], *(i for i in nodes[k] if i is not None)])
    for a, k in enumerate(keys):
        out[k] = (smallest[find(a)], links[a], len(nodes[k]))
    return out


def check(spark, texts, **options):
    df = documents(spark, texts)
    want = brute(texts)
    by_id = defaultdict(list)
    for i, t in texts:
        w = tuple(words(t))
        by_id[i].append(want[w] if w else (i, 0, 1))
    got = defaultdict(list)
    for r in J.jaccard_classes(df, **options).collect():
        got[r.doc_id].append((r.class_id, r.n_links, r.n_copies))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in by_id.items()}


def near_copies(seed=1, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(6, 150))]
        for _ in range(rng.choice([1, 2, 3, 8, 25])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


def test_bands_reach_the_target():
    bands, rows = J.choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.9995 and bands * rows <= J.MAX_HASHES
    with pytest.raises(ValueError):
        J.choose_bands(0.01, 0.999999, 4)


@pytest.mark.parametrize("block", [256, 4])
def test_against_brute_force(spark, block):
    check(spark, near_copies(), block=block)


def test_messy_rows(spark):
    rows = [(r.doc_id, r.text) for r in messy(spark).collect() if r.doc_id is not None]
    check(spark, rows)


def test_keep_first(spark):
    texts = near_copies(2, 6) + [(5, None), (6, ""), (7, "")]
    df = documents(spark, texts)
    want = brute(texts)
    keep = {i for i, t in texts if not words(t) or want[tuple(words(t))][0] == i}
    out = J.keep_first(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(keep)


def test_hot_group_makes_no_pairs(spark):
    """A group of 400 near copies gives 400 rows, however many links they have."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(400):
        copy = list(base)
        copy[rng.randrange(120)] = f"x{i}"
        texts.append((i, " ".join(copy)))
    out = J.jaccard_classes(documents(spark, texts), block=64).collect()
    assert len(out) == 400 and {r.class_id for r in out} == {0}
    assert min(r.n_links for r in out) > 390


def test_empty(spark):
    assert J.jaccard_classes(empty(spark)).collect() == []
