"""Substring dedup against a brute force over word tuples."""

import hashlib
import random
import re

import pytest

from docloom.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=13):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - size + 1) if i is not None else ():
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - size + 1) if i is not None else ():
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def planted(n=300, seed=5):
    rng = random.Random(seed)
    vocabulary = ["w" + str(i) for i in range(400)] + ["the", "of", "é", "日本"]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    hot, exact13 = text(30), text(13)
    docs = []
    for i in range(n):
        parts = [text(rng.randrange(0, 60))]
        if i % 3 == 0:
            parts.append(hot)
        if i % 11 == 0:
            parts.append(exact13)
        if docs and i % 7 == 0:
            near = rng.choice(docs)[1].split(" ")
            near[rng.randrange(len(near))] = "changed"
            parts = near
        docs.append((i * 3 % n, rng.choice([" ", "\n", "\t", "  "]).join(parts)))
    docs += [(n + i, docs[4][1]) for i in range(30)]  # exact copies
    docs += [(n + 100, None), (n + 101, ""), (None, docs[0][1]), (n + 102, "a b c"), (n + 103, "a b c"), (5, docs[9][1]), (n + 104, "x " * 60), (n + 105, "x " * 30)]
    return docs


@pytest.mark.parametrize("frequent", [20, 10**9])
def test_against_brute_force(spark, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(substring_dedup, "FREQUENT", frequent)
    docs = planted()
    spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, copy string, windows int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, substring_dedup.op7_substring_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(docs)


def test_given_documents_and_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, substring_dedup.op7_substring_dedup(spark, sf_dir).collect()), key=str) == brute(rows)
    texts = {r.doc_id: r for r in substring_dedup.remove_repeated(docs).collect()}
    for i, n, gone, digest in brute(rows):
        r = texts[i]
        assert (r.n_words, r.n_removed) == (n, gone)
        assert hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() == digest


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeated(docs).count() == 0
