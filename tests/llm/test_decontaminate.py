"""Leaks against a brute-force edit distance: verbatim, edited and absent ones."""

import random
import re

import numpy as np

from docloom.llm import decontaminate as d
from docloom.llm.arrowtext import U64


def split(text):
    return re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (text or ""))


def fold(text):
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in split(text)]


def distance(item, text):
    """Least edits between the item and any part of the text (plain dynamic programming)."""
    prev = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(prev[j - 1] + (x != y), prev[j] + 1, now[-1] + 1))
        prev = now
    return min(prev)


def test_distances():
    rng = random.Random(1)
    seqs = [([rng.randrange(6) for _ in range(rng.randrange(1, 12))], [rng.randrange(6) for _ in range(rng.randrange(0, 20))]) for _ in range(300)]
    got = d.distances([np.array(a, U64) + U64(1) for a, _ in seqs], [np.array(b, U64) + U64(1) for _, b in seqs])
    assert got.tolist() == [distance(a, b) for a, b in seqs]


def test_given_tables(spark, sf_dir):
    """Every pair that brute force finds through shared word pairs."""
    docs = [(r.doc_id, fold(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, fold(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {}
    for i, t in docs:
        grams = set(zip(t, t[1:], t[2:], strict=False))
        for k, b in items:
            if sum(g in grams for g in zip(b, b[1:], b[2:], strict=False)) >= len(b) / 2:
                e = distance(b, t)
                if e <= d.edits(len(b)):
                    want[i, k] = e
    got = {(r.doc_id, r.item_id): r.n_edits for r in d.op3_decontaminate(spark, sf_dir).collect()}
    assert got == want


def test_edited_passages(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(2000)] + ["the", "of", "and"] * 60
    text = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = [(i, text(rng.randrange(8, 70))) for i in range(60)]
    docs, planted = [], {}
    for n in range(400):
        k, item = items[n % 60]
        allowed = int(d.edits(len(item)))
        e = 0 if n < 100 else 1 + n % allowed if allowed > 1 else 1
        seq = list(item)
        for _ in range(e):
            at, op = rng.randrange(len(seq)), rng.randrange(3)
            seq[at : at + (op != 0)] = [] if op == 1 else [f"new{rng.randrange(10**6)}"]
        docs.append((n, " ".join(text(rng.randrange(50)) + [w.upper() + "," for w in seq] + text(rng.randrange(50)))))
        planted[n, k] = e
    docs += [(1000 + n, " ".join(text(200))) for n in range(100)]
    docs += [(2000, None), (2001, ""), (None, " ".join(items[0][1])), (2002, "w1"), (2003, " ".join(items[1][1][: len(items[1][1]) // 2]))]
    frame = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(k, " ".join(b)) for k, b in items] + [(900, None), (901, "the of and"), (None, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_edits for r in d.find_leaks(frame, bench).collect()}
    assert got.pop((None, 0)) == 0
    short = {(n, 901): 0 for n, t in docs if n is not None and " the of and " in f" {' '.join(fold(t))} "}
    assert {k: got.pop(k, None) for k in short} == short and short
    assert all(got[k] == 0 for k, e in planted.items() if e == 0)
    assert set(got) <= set(planted)
    edited = [k for k, e in planted.items() if e]
    assert np.mean([k in got for k in edited]) >= 0.95, np.mean([k in got for k in edited])
    assert all(got[k] <= planted[k] for k in got)
    kept = d.without_leaks(frame, bench)
    assert kept.columns == frame.columns and kept.where("doc_id >= 1000").count() == 104
    assert d.find_leaks(frame.limit(0), bench).count() == 0
    assert d.find_leaks(frame, bench.limit(0)).count() == 0


def test_interior_replacements_at_the_limit(spark):
    """Items of 20 and 40 words, where the fewest word pairs of their size class stay; no other pair is near."""
    rng, new = random.Random(3), iter(range(10**6))
    fresh = lambda k: [f"x{next(new)}" for _ in range(k)]
    items, docs = [], []
    for n in (20, 40):
        for _ in range(50):
            item, e = fresh(n), int(d.edits(n))
            seq = list(item)
            for at in rng.sample(range(2, n - 2, 3), e):
                seq[at] = next(iter(fresh(1)))
            docs.append((len(items), " ".join(fresh(30) + seq + fresh(30))))
            items.append((len(items), " ".join(item)))
    found = d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_edits) for r in found) == [(i, i, 2 if i < 50 else 4) for i in range(100)], len(found)


def test_needed_pairs_hold_for_every_length():
    for c in range(int(d.class_of(np.array(5))), int(d.class_of(np.array(2000)))):
        low, high = d.class_range(c)
        assert d.pairs_needed(c) <= min(n - 1 - 2 * int(d.edits(n)) for n in range(low, high + 1))


def test_short_items_stand_in_the_text(spark):
    """Items of one to four words, verbatim; the second text holds one with another word between."""
    rng = random.Random(3)
    filler = lambda k: [f"f{rng.randrange(300)}" for _ in range(k)]
    items = [(i, [f"s{i}w{j}" for j in range(1 + i % 4)]) for i in range(40)]
    docs, want = [(1000, None), (1001, "")], set()
    for n in range(160):
        k, item = items[n % 40]
        docs.append((n, " ".join(filler(20) + [w.title() for w in item] + filler(5) + item) + "."))
        want.add((n, k))
        docs.append((500 + n, " ".join(filler(9) + [item[0], "zz", *item[1:]] + filler(4))))
        if len(item) == 1:
            want.add((500 + n, k))
    frame = spark.createDataFrame([*docs, docs[5]], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(b)) for k, b in items] + [(900, None), (901, " - ")], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.n_edits) for r in d.find_leaks(frame, bench).collect()]
    assert sorted(got) == sorted((i, k, 0) for i, k in want)


def test_a_text_of_many_items(spark):
    """One text that lists 300 items beside short candidates: slices are bounded by words, not by pairs."""
    rng = random.Random(4)
    items = [(i, [f"w{rng.randrange(4000)}" for _ in range(20)]) for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join(w for _, b in items for w in b)), (2, " ".join(items[7][1]))], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(b)) for k, b in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_edits for r in d.find_leaks(docs, bench).collect()}
    assert got == {(1, k): 0 for k, _ in items} | {(2, 7): 0}
