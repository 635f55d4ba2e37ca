"""Near-duplicate groups and what they are made of, against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from criterium.llm import components as C
from criterium.llm import near_duplicates, shingles
from tests.llm.conftest import ODD

# what the operator promises, written down anew


def brute_grams(text):
    found = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return Counter(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else Counter()


def brute_similarity(a, b, idf):
    low = sum(min(n, b[g]) * idf(g) for g, n in a.items() if g in b)
    return low / (sum(n * idf(g) for g, n in a.items()) + sum(n * idf(g) for g, n in b.items()) - low) if a and b else 0.0


def brute_classes(texts):
    """The smallest position in each text's class."""
    grams, n = [brute_grams(t) for t in texts], len(texts)
    df = Counter(g for c in grams for g in c)

    def idf(g):
        return 1.0 if df[g] <= 0.01 * n else min(1.0, max(0.5, math.log(n / df[g]) / math.log(100)))

    places = {}
    for k, t in enumerate(texts):
        places.setdefault(t or "", []).append(k)
    seen = list(places)
    root = list(range(len(seen)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, t in enumerate(seen):
        for g in grams[places[t][0]]:
            holders.setdefault(g, []).append(i)
    pairs = {(i, j) for h in holders.values() if len(h) < 200 for i in h for j in h if i < j}
    for i, j in pairs:
        if find(i) != find(j) and brute_similarity(grams[places[seen[i]][0]], grams[places[seen[j]][0]], idf) >= 0.8 - 1e-9:
            root[find(i)] = find(j)
    first = {}
    for i, t in enumerate(seen):
        first[find(i)] = min(first.get(find(i), n), places[t][0])
    return [first[find(seen.index(t or ""))] for t in texts]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    passage, texts = words(rng, 60), []
    for _ in range(25):
        base = words(rng, rng.randint(30, 120)).split()
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "edited"
            texts.append(" ".join(copy))
    texts += [words(rng, 60) + " " + passage for _ in range(20)]
    return texts + ["", "", "?!", "short one", "short one"]


def found(spark, texts, parts=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_duplicates.groups(docs.repartition(parts) if parts else docs).collect()
    return {r["doc_id"]: (r["class_id"], r["class_size"]) for r in rows}


def wanted(texts):
    classes = brute_classes(texts)
    sizes = Counter(classes)
    return {k: (c, sizes[c]) for k, c in enumerate(classes)}


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, seed):
    texts = corpus(seed)
    assert found(spark, texts) == wanted(texts)


def test_families_of_many_blocks_equal_brute_force(spark, monkeypatch):
    """A family held together by a template, with small groups of its own, in blocks of few texts."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    rng = random.Random(5)
    template, texts = words(rng, 100), []
    for _ in range(40):
        own = words(rng, 10)
        texts += [f"{template} {own}", f"{template} {own} {words(rng, 1)}"]
    want = wanted(texts)
    assert max(n for _, n in want.values()) < 10 and found(spark, texts) == want


def test_blocks_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "GRAMS", 400)
    texts = corpus(3)
    assert found(spark, texts) == wanted(texts)


def test_pairs_among_thousands_that_share_a_passage(spark):
    """Ten pairs of similarity 0.9 among 2,500 texts that are 0.7 like each other; the same however the rows are dealt."""
    rng = random.Random(8)
    passage = words(rng, 160)
    texts = [f"{words(rng, 25)} {passage}" for _ in range(2490)]
    texts += [f"{t} {words(rng, 4)}" for t in texts[:10]]
    grams = [brute_grams(texts[k]) for k in (0, 1, 2490)]
    weighed = lambda a, b: brute_similarity(a, b, lambda g: 0.5 if g in grams[0] and g in grams[1] else 1.0)
    assert 0.55 < weighed(grams[0], grams[1]) < 0.8 < weighed(grams[0], grams[2])
    got = found(spark, texts)
    assert {k: c for k, (c, _) in got.items() if c != k} == {2490 + k: k for k in range(10)}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert found(spark, texts, 60) == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_tight_group_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 10)
    rng = random.Random(9)
    base = words(rng, 300).split()
    texts = []
    for _ in range(150):
        copy = list(base)
        copy[rng.randrange(300)] = words(rng, 1)
        texts.append(" ".join(copy))
    texts += [words(rng, 40) for _ in range(20)]
    want = wanted(texts)
    assert want[149] == (0, 150) and found(spark, texts) == want


def test_frequent_shingles_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(shingles, "COUNTERS", 64)
    rng = random.Random(4)
    common = [words(rng, 5) for _ in range(6)]
    texts = [f"{words(rng, 20)} {common[k % 6] if k % 3 else ''}" for k in range(600)]
    df = Counter(g for t in texts for g in brute_grams(t))
    want = sorted(n for n in df.values() if n > 6)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for parts in (1, 50):
        assert sorted(shingles.frequent_shingles(docs.repartition(parts), 600).values()) == want
    assert shingles.frequent_shingles(docs.limit(0), 0) == {}


def test_words_at_the_edges_of_slices():
    long = "w" * 70_000
    for text in ["", "a", "a b a", "é日本 x_y", f"{long} b {long}", "q " * 40_000 + "z" * 65_536, "z" * 65_535 + " z", " " * 70_000 + "abc", "ab" * 32_768 + "." + "ab" * 32_768]:
        hashes, own = shingles.word_hashes(text).tolist(), re.findall(r"[a-z0-9\x80-\U0010ffff]+", text)
        assert len(hashes) == len(own) and len(set(zip(hashes, own))) == len(set(hashes)) == len(set(own))
    assert shingles.word_hashes(long)[0] == shingles.word_hashes(f"b {long}!")[1]


def test_pairwise_equals_brute_force():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b"]) for _ in range(rng.randint(1, 60))) for _ in range(30)] + ["x " * 500, "x " * 300, "x y " * 80]
    grams = [shingles.shingles(t) for t in texts]
    frequent = {int(grams[0][0][0]): 20}
    weights = shingles.Weights(frequent, 33)
    near_duplicates.COLUMNS, before = 16, near_duplicates.COLUMNS
    try:
        got = near_duplicates.pairwise(grams, weights)
        side = np.array([k % 2 for k in range(len(texts))])
        cross = near_duplicates.pairwise(grams, weights, side)
    finally:
        near_duplicates.COLUMNS = before
    idf = dict(zip(weights.hashes.tolist(), weights.idf_of.tolist()))
    counted = [Counter(dict(zip(h.tolist(), c.tolist()))) for h, c in grams]
    want = np.array([[brute_similarity(a, b, lambda g: idf.get(g, 1.0)) for b in counted] for a in counted])
    np.fill_diagonal(got, 1)  # what a text alone holds is left out
    assert np.allclose(got, want) and np.allclose(cross, want[side == 0][:, side == 1])


def test_odd_rows(spark, odd, empty):
    rows = near_duplicates.groups(odd).collect()
    assert len(rows) == len(ODD)
    classes = {r["doc_id"]: r["class_id"] for r in rows}
    assert classes[5] == classes[1] == 1 and classes[3] == classes[2] == 2 and classes[4] == 4
    assert near_duplicates.groups(empty).count() == 0 == near_duplicates.keep_one(empty).count()
    kept = near_duplicates.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, k) for k in (1, 2, 4, 7, 8, 9)] + [(True, None)]


def test_one_of_each_class_stays(spark):
    """Rows that repeat an id with other texts, rows without an id, rows that are equal, and columns named like the operator's own."""
    a, b, c, d = (words(random.Random(k), 30) for k in range(4))
    rows = [(5, a, "1"), (5, b, "2"), (3, a, "3"), (3, a, "3"), (None, c, "4"), (None, c, "4"), (None, c, "0"), (None, d, "5"), (7, d + " more", "6"), (7, d + " more", "7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").selectExpr("*", "node AS class_id", "node AS first", "node AS key", "1 AS _id")
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["text"], r["node"]) for r in kept.collect()) == sorted([(a, "3"), (b, "2"), (c, "0"), (d + " more", "6")])
    got = Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in near_duplicates.groups(docs).collect())
    assert got == Counter([(5, 3, 3), (3, 3, 3), (3, 3, 3), (5, 5, 1), (None, None, 3), (None, None, 3), (None, None, 3), (None, 7, 3), (7, 7, 3), (7, 7, 3)])


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 400, dtype=np.uint64)
    h.sort()
    sampler = near_duplicates.Sampler(2000, seed=5)
    wa, wb = rng.choice([0.5, 1, 2, 3], 300), rng.choice([0.5, 1, 2, 3], 300)
    wb[:200] = np.where(rng.random(200) < 0.7, wa[100:], wb[:200])
    a, b = sampler(h[:300], wa, np.array([0]))[0], sampler(h[100:], wb, np.array([0]))[0]
    low = np.minimum(wa[100:], wb[:200]).sum()
    assert abs((a == b).mean() - low / (wa.sum() + wb.sum() - low)) < 0.05


@pytest.mark.parametrize("rows", [C.ROWS, 20])
def test_components(spark, monkeypatch, rows):
    monkeypatch.setattr(C, "ROWS", rows)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(0, k) for k in range(300, 340)] + [(k, k + 1) for k in range(400, 430)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
