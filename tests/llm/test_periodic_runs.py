"""Periodic runs against a brute force over all periods and places."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from docloom.llm import periodic_runs as pr
from docloom.runtime import table


def brute(words):
    """All maximal stretches by period; a multiple of a period is left out."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(24, 3 * q) and not any(s == i and size == length for s, size, _ in out):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def edges_of(texts):
    return np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


@pytest.mark.parametrize("scale", [8, 16, 64, 128, 512])
def test_transform_is_the_exact_sum_of_squares(scale):
    rng = np.random.default_rng(scale)
    codes = rng.integers(0, int((65536 / scale) ** 0.5) + 1, 6 * scale)
    codes[3 * scale : 4 * scale] = codes[:scale]
    at, far = pr.zero_mismatches(codes, np.array([0, scale]), scale, scale if scale > 8 else 1, scale if scale > 8 else 15)
    want = [(b, d) for b in (0, scale) for d in range(scale if scale > 8 else 1, (2 * scale)) if np.array_equal(codes[b : b + scale], codes[b + d : b + d + scale])]
    assert sorted(zip(at.tolist(), far.tolist(), strict=True)) == want


def test_runs_equal_brute_force():
    rng = random.Random(5)
    texts = []
    for kind in range(120):
        words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(0, 160))]
        for _ in range(kind % 4):  # stretches of any period, cut anywhere, side by side or one in another
            unit = [rng.randrange(4) for _ in range(rng.randrange(1, 40))]
            size = rng.randrange(10, 260)
            at = rng.randrange(len(words) + 1)
            words[at:at] = (unit * (size // len(unit) + 1))[:size]
        texts.append(words)
    texts += [[0] * 23, [0] * 24, [0, 1] * 12, list(range(8)) * 3, list(range(8)) * 3 + [0], (list(range(9)) * 3)[:26], []]
    ids = np.concatenate([np.array(t, np.int64) for t in texts])
    found = pr.find_runs(ids, edges_of(texts))
    for t, got in zip(texts, found, strict=True):
        assert got == brute(t)


def test_long_periods_and_nested_runs():
    rng = random.Random(7)
    unit = [rng.randrange(5000) for _ in range(1700)]
    inner = [1, 2] * 30
    long_text = [9] * 40 + unit * 4 + unit[:13] + [77] + (inner + [rng.randrange(100) for _ in range(600)]) * 3
    text = [long_text, [3] * 9000]
    got = pr.find_runs(np.array(sum(text, []), np.int64), edges_of(text))
    assert got[0] == brute(long_text) and (40, 4 * 1700 + 13, 1700) in got[0]
    assert got[1] == [(0, 9000, 1)]


def test_nulls_blanks_repeats_and_clashing_columns(spark):
    long_text = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, 1), (2, "", 2), (3, " \n\t ", 3), (4, "a\tb\n" * 12, 4), (4, "a\tb\n" * 12, 4), (None, "é x " * 30, 5), (6, long_text + " z" * 30, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted(pr.periodic_runs(docs).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in got] == [
        (None, 30, [(0, 30, 1)]), (1, 0, []), (2, 0, []), (3, 0, []), (4, 24, [(0, 24, 2)]), (4, 24, [(0, 24, 2)]), (6, 60_030, [(60_000, 30, 1)]),
    ]
    assert [r.collapsed for r in got][:5] == ["é x", "", "", "", "a b"] and got[-1].collapsed == long_text + " z"
    assert pr.periodic_runs(docs.limit(0)).count() == 0
    plant = {r.doc_id: r.text for r in pr.planted(docs.select("doc_id", "text")).collect()}
    assert plant[1] is None and plant[None] == "é x " * 30


def test_query_equals_brute_force(spark, sf_dir):
    got = {r.doc_id: r for r in pr.op11_periodic_runs(spark, sf_dir).collect()}
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    planted = 0
    for d, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(d).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute(words) if len(words) < 4000 else [tuple(x) for x in pr.find_runs(np.unique(words, return_inverse=True)[1], np.array([0, n]))[0]]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        r = got[d]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert planted > 10 and sum(r.n_runs > 0 for r in got.values()) > 10
