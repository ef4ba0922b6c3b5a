"""Licence scans against a plain Python version and the DuckDB oracle."""

import duckdb

from docloom.llm import licenses


def dice(words, template):
    b, t = {f"{x} {y}" for x, y in zip(words, words[1:], strict=False)}, set(licenses.template_bigrams(template))
    return 2 * len(b & t) / (len(b) + len(t)) if b else 0


def brute(text, threshold=licenses.THRESHOLD):
    best = {}
    lines, words = (text or "").split("\n"), licenses.normalised(text or "")
    for p in lines + ([text] if len(lines) > 1 else []):
        for name in {m for m, _ in licenses.TEMPLATES}:
            best.setdefault(name, []).append(max(dice(licenses.normalised(p), t) for m, t in licenses.TEMPLATES if m == name))
    for name, t in licenses.TEMPLATES:
        n = len(licenses.normalised(t))
        for start in range(0, len(words) - n + 1, licenses.step_of(n)):
            best.setdefault(name, []).append(dice(words[start : start + n], t))
    hits = {name: [d for d in all_of if d >= threshold] for name, all_of in best.items()}
    return [(name, round(max(d), 6), len(d)) for name, d in hits.items() if d]


NOTICE = dict(reversed(licenses.TEMPLATES))
ODD = [
    None, "", "\n", "MIT", NOTICE["MIT"], f"x\n{NOTICE['MIT']}\n{NOTICE['MIT'].upper()}!", "Released under the MIT", "(Released, under: the MIT licence)", (NOTICE["MIT"] + " ") * 300, "word " * 5000 + "\n" + NOTICE["GPL-3.0"],
    "Licensed under the Apache License Version 2", "Licensed under CC BY-NC 4.0\r", "Licensed under CC BY-SA 4.0", licenses.TEMPLATES[7][1].replace("later", "earlier"), "licenses licenses licenses",
]


def test_against_brute_force(spark):
    given = [(i, t) for i, t in enumerate(ODD)] + [(None, NOTICE["MIT"]), (4, NOTICE["MIT"])]
    docs = spark.createDataFrame([(*g, "x") for g in given], "doc_id long, text string, license string")
    got = sorted(map(tuple, licenses.scan_licenses(docs).collect()), key=str)
    assert got == sorted([(i, *x) for i, t in given for x in brute(t)], key=str)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    assert licenses.scan_licenses(docs, templates=[]).count() == 0


def test_wrapped_commented_and_embedded_notices(spark):
    """Notices over several lines, in comments, within prose, and whole licence texts within a file."""
    full = {name: text for name, text in licenses.TEMPLATES if len(text) > 250}
    wrapped = lambda text, head: "\n".join(head + " ".join(text.split(" ")[i : i + 9]) for i in range(0, len(text.split(" ")), 9))
    docs, want = [], {}
    for name, text in full.items():
        for head in ("", "// ", " * ", "# "):
            docs.append((len(docs), f"int x;\nint y;\n{wrapped(text, head)}\nreturn 1;\n" + "more code here\n" * 40))
            want[docs[-1][0]] = name
        docs.append((len(docs), "some prose before it " * 30 + text + " and some after it" * 30))
        want[docs[-1][0]] = name
    docs.append((len(docs), "no notice at all " * 500))
    got = {}
    for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert set(got) == set(want) and all(want[i] in names for i, names in got.items())


def test_a_very_long_text(spark):
    docs = [(1, "word " * 400_000 + NOTICE["MIT"]), (2, ("licence software notice " * 20_000).strip())]
    got = {r.doc_id: r.license for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: "MIT"}


def test_oracle(spark):
    folder = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = sorted(map(tuple, licenses.op8_license_scan(spark, folder).select("doc_id", "license", "dice", "n_passages").collect()))
    want = sorted(duckdb.execute(licenses.oracle()).fetchall())
    assert got == want and len(got) > 10


def test_anchors_lose_nothing():
    wanted = [licenses.template_bigrams(t) for _, t in licenses.TEMPLATES]
    heads = licenses.anchors(wanted, licenses.THRESHOLD)
    assert heads
    for b in wanted:
        k = sum(1 for g in b if not set(g.split(" ")) & set(heads))
        assert 2 * k / (k + len(b)) < licenses.THRESHOLD
