"""Language ID: kernel against sets of strings, the fit against the dual solution, and accuracy on held-out documents."""

import re

import numpy as np
import pytest

from docloom.llm import language_id as li
from docloom.runtime import table


def string_grams(text):
    out = set()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f" {w} "
        out |= {padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)} - {" "}
    return out


TEXTS = ["The cat sat on the mat.", "der Hund, die Katze", "été à Noël!", "A", "x y z", "日本 語", "the the THE"]


@pytest.mark.parametrize("text", TEXTS)
def test_grams_are_those_of_the_words(text):
    got = {"".join(chr(p) for p in (g >> 42 & 0x1FFFFF, g >> 21 & 0x1FFFFF, g & 0x1FFFFF) if p) for g in li.grams(text).tolist()}
    assert got == string_grams(text)


def test_no_letters():
    assert all(not len(li.grams(t)) for t in (None, "", " \n", "12 34 !?", "🙂"))


def test_kernel_equals_set_intersections():
    samples = [("a" if i % 2 else "b", li.grams(t)) for i, t in enumerate(TEXTS)]
    machine = li.fit(samples)
    sets = [string_grams(t) for t in TEXTS]
    want = np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in sets] for x in sets])
    assert np.allclose(machine.kernel([s for _, s in samples]), want, atol=1e-6)


def test_with_all_texts_as_landmarks_it_is_kernel_ridge_regression(monkeypatch):
    """Then the Nyström map is exact, and the dual solution gives the same values."""
    monkeypatch.setattr(li, "RIDGES", (0.1,))
    samples = [("a", li.grams(t)) for t in TEXTS[:3]] + [("b", li.grams(t)) for t in TEXTS[3:6]]
    machine = li.fit(samples)
    k = machine.kernel([s for _, s in samples]).astype(float)
    y = np.array([[1, -1]] * 3 + [[-1, 1]] * 3, float)
    assert np.allclose(k @ machine.weights, k @ np.linalg.solve(k + 0.1 * np.eye(6), y), atol=1e-4)


def test_nulls_empty_tables_and_clashing_columns(spark):
    rows = [(1, "the cat and the dog with the", "en", 0.5), (2, "der Hund und die Katze nicht", "de", 0.5), (3, None, "en", 0.5), (4, "123", None, 0.5), (None, "the end " * 20_000, None, 0.5), (1, "the cat and the dog with the", "en", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = sorted((r.doc_id or 0, r.lang_pred, r.score > 0.5) for r in li.identify_languages(docs, docs).collect())
    assert got == [(0, "en", True), (1, "en", True), (1, "en", True), (2, "de", True), (3, "und", False), (4, "und", False)]
    nothing = li.identify_languages(docs, docs.where("lang IS NULL")).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)} and len(nothing) == 6
    assert li.identify_languages(docs.limit(0), docs).count() == 0
    one = li.identify_languages(docs, docs.where("lang = 'en'")).collect()
    assert {r.lang_pred for r in one} == {"en", "und"}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = li.op13_language_id(spark, folder).join(table(spark, folder, "documents").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97


def test_sample_bound(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    machine = li._train(docs, 20)
    assert machine.languages == ["de", "en", "es", "fr"] and machine.presence.shape[1] <= 80
