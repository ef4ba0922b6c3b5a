"""Base counts against brute force; Viterbi against enumeration; the verdict against labels."""

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from docloom.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line) and line in seen:
            dup += 1
        seen.add(line)
    threes = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(threes)
    again = {k for i, t in enumerate(threes) if times[t] > 1 for k in range(i, i + 3)}
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), failed


ODD = [None, "", " ", "\n", "a", "a\na\n a\na", "é é é\né é é", "\n\n\n", "# * | <>", "x y z " * 40, "line\n" * 500, "\ta\x0bb\x0cc\r\nd", "日本\n日本\n", "a\n\na\n"]


def test_base_counts(spark, sf_dir, tmp_path):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(10**6 + i, x) for i, x in enumerate(ODD)] + [(None, "a b c"), (1, "again")]
    spark.createDataFrame([(*g, "k") for g in given], "doc_id long, text string, kept string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    got = q.op6_quality_rules(spark, str(tmp_path)).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted([(r.doc_id, *(r[c] for c in columns)) for r in got], key=str) == sorted([(i, *brute(t)) for i, t in given], key=str)
    assert all(not r.kept for r in got if r.base_failed)


def test_verdicts_follow_the_labels(spark):
    folder = "/root/testdata/sf0.01"
    verdict = {r.doc_id: r for r in q.op6_quality_rules(spark, folder).collect()}
    rated = [(verdict[r.doc_id], r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    clean = [v.kept for v, y in rated if y == 1 and not v.base_failed]
    junk = [v.kept for v, y in rated if y == 0]
    assert np.mean(clean) > 0.97, np.mean(clean)
    assert np.mean(junk) < 0.1, np.mean(junk)


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(1)
    field = q.Field(rng.normal(size=(3, 2)), rng.normal(size=2), rng.normal(size=(2, 2)))
    sizes = [0, 1, 2, 5, 7, 0, 3, 8]
    rows = np.cumsum([0, *sizes])
    x = rng.normal(size=(rows[-1], 3))
    got = q.viterbi(field, x, rows)
    for a, b in itertools.pairwise(rows):
        s = x[a:b] @ field.weights
        score = lambda y: sum(s[t, k] for t, k in enumerate(y)) + (field.start[y[0]] if len(y) else 0) + sum(field.move[i, j] for i, j in itertools.pairwise(y))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=b - a), key=score)
        assert tuple(got[a:b]) == best


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "x")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in q.judge_quality(docs, labels).collect()] == [True]
    assert q.judge_quality(docs.limit(0), labels).count() == 0


def test_lines_of_mixed_documents_are_marked(spark):
    """Texts of which one part is a good document and the other a bad one: most lines get their own label."""
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rated = sorted((r.doc_id, r.quality) for r in labels.collect())
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    field = q._train(docs.where("doc_id % 2 = 0"), labels)  # so that odd documents are new to it
    good = [texts[i] for i, y in rated if y == 1 and i % 2 and q.MIN_WORDS < len(texts[i].split()) < 3000][:40]
    bad = [texts[i] for i, y in rated if y == 0 and i % 2 and q.MIN_WORDS < len(texts[i].split()) < 3000][:40]
    right, total = 0, 0
    for a, b in zip(good, bad, strict=False):
        n, m = (sum(bool(line.strip()) for line in t.split("\n")) for t in (a, b))
        column = pa.array([a + "\n" + b])
        data, offsets = q.utf8(column)
        x, _, rows, _ = q.line_features(column, data, offsets, q.words(column))
        got = q.viterbi(field, x, rows)
        assert len(got) == n + m
        right += int((got[:n] == 1).sum() + (got[n:] == 0).sum())
        total += n + m
    assert total > 200 and right >= 0.85 * total, (right, total)
    assert field.move[0, 0] > field.move[0, 1] and field.move[1, 1] > field.move[1, 0]


def test_conflicting_labels_and_repeated_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    once = q._train(docs, labels)
    wrong = labels.where("doc_id % 3 = 0").withColumn("quality", 1 - labels.quality)
    both = q._train(docs, labels.unionByName(wrong))
    without = q._train(docs, labels.where("doc_id % 3 <> 0"))
    assert np.array_equal(both.weights, without.weights) and not np.array_equal(both.weights, once.weights)
    again = q._train(docs.unionByName(docs), labels.unionByName(labels))
    assert np.array_equal(again.weights, once.weights)
