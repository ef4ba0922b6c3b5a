"""Dart signatures against weighted similarity; classes against brute force."""

import random
import re

import numpy as np
import pytest

from docloom.llm import near_dedup as n
from docloom.llm.arrowtext import U64

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    """Least id of each class; pairs are found through an inverted index, so all are seen."""
    sets = {i: grams(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for i, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in index.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    for a, b in pairs:
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("weights", [False, True])
def test_signatures_estimate_similarity(weights):
    rng = np.random.default_rng(2)
    k = 4096
    for size, shared in ((3, 2), (40, 30), (2000, 1500)):
        a = rng.integers(0, 2**63, size).astype(U64)
        b = np.concatenate([a[:shared], rng.integers(0, 2**63, size - shared).astype(U64)])
        wa = rng.uniform(0.2, 4, size) if weights else np.ones(size)
        wb = np.concatenate([wa[:shared] * rng.uniform(0.5, 1.5, shared), rng.uniform(0.2, 4, size - shared)]) if weights else np.ones(size)
        sig = n.signatures(np.concatenate([a, b]), np.repeat([0, 2], size), np.concatenate([wa, wb]), 3, k)
        both = np.minimum(wa[:shared], wb[:shared]).sum()
        true = both / (wa.sum() + wb.sum() - both)
        assert abs((sig[0] == sig[2]).mean() - true) < 0.04
        assert not sig[1].any()


def planted(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = text(40)
    docs = []
    for g in range(25):
        base = text(rng.randrange(60, 300))
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(" ".join(copy))
    big = text(150)
    for _ in range(150):  # one large group, not all of it within reach of one member
        copy = list(big)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        docs.append(" ".join(copy))
    docs += [" ".join(text(30) + passage + text(30)) for _ in range(60)]
    docs += [docs[0]] * 20 + ["a b", "a b", "a  b\n", "a c", "", " ", None, "x " * 200, "x " * 300]
    rng.shuffle(docs)
    return [(i * 2, d) for i, d in enumerate(docs)] + [(None, docs[0])]


def test_classes_against_brute_force(spark):
    rows = planted()
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, class_id int")
    got = {r.doc_id: r.class_id for r in n.near_duplicates(docs).collect()}
    want = brute(rows)
    assert got.pop(None) is None
    assert got == want
    kept = n.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert kept.columns == docs.columns


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r.class_id for r in n.op2_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in n.near_duplicates(docs).collect()) == [(1, 1), (1, 1), (2, 1), (2, 1)]
    assert n.near_duplicates(docs.limit(0)).count() == 0
    counted = spark.createDataFrame([(1, "a b c d e " * 40 + "z"), (2, "a b c d e " * 20 + "z")], "doc_id long, text string")
    assert [r.class_id for r in n.near_duplicates(counted).orderBy("doc_id").collect()] == [1, 1]
    assert [r.class_id for r in n.near_duplicates(counted, weighting="count").orderBy("doc_id").collect()] == [1, 2]


def family(rng, couples=100):
    """Texts on one template: any two are alike to 0.78, the two of a couple to 0.82."""
    words = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    template, docs = words(176), []
    for _ in range(couples):
        both = words(5)
        docs += [" ".join(template + both + words(19)) for _ in range(2)]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_couples_in_a_family_below_the_threshold(spark):
    rows = family(random.Random(5))
    want = brute(rows)
    assert len(set(want.values())) == len(rows) // 2
    got = {r.doc_id: r.class_id for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[i] == c for i, c in want.items() if i != c)
    assert got == want, f"{found} of {len(rows) // 2} couples"


@pytest.mark.parametrize("centre", [True, False])
def test_families_of_any_distance(spark, centre):
    """Copies with few to many changes, with and without the text they come from; most pairs are below the threshold."""
    rng, rows = random.Random(8), []
    words = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    for length in (60, 150, 400):
        base = words(length)
        for _ in range(120):
            copy = list(base)
            for _ in range(rng.randrange(1 if centre else max(1, length // 80), max(3, length // 25))):
                at, op = rng.randrange(len(copy)), rng.randrange(3)
                copy[at : at + (op != 0)] = [] if op == 1 else words(1)
            rows.append(" ".join(copy))
        rows += [" ".join(base)] * centre
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = {r.doc_id: r.class_id for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_very_long_texts(spark):
    rng = random.Random(6)
    long = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    near = long[:280_000] + [f"v{i}" for i in range(10_000)]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, "\n".join(long)), (4, "x" * 3_000_000)]
    got = {r.doc_id: r.class_id for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
