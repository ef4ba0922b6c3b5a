"""Every stage on its own input, against brute force."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as p
from docloom.llm import decontaminate
from docloom.runtime import materialize
from tests.llm.test_decontaminate import distance, fold
from tests.llm.test_near_dedup import brute as classes
from tests.llm.test_quality_rules import brute as base

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    docs, kept = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, stage in p.STAGES[:-1]:
        docs = materialize(stage(spark, docs, FOLDER))
        assert docs.columns == p.COLUMNS
        kept.append({r.doc_id: r for r in docs.collect()})
    given = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    one, two, three, four = kept
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(not base(r.text)[-1] and r == given[i] for i, r in one.items())
    good = [i for i, y in quality.items() if y == 1 and not base(given[i].text)[-1]]
    assert sum(i in one for i in good) > 0.97 * len(good)
    assert set(two) == set(classes([(i, r.text) for i, r in one.items()]).values())
    items = [fold(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for i, r in two.items():
        words = fold(r.text)
        pairs = set(zip(words, words[1:], strict=False))
        near = [b for b in items if sum(x in pairs for x in zip(b, b[1:], strict=False)) >= 0.6 * len(b)]
        assert (i not in three) == any(distance(b, words) <= decontaminate.edits(len(b)) for b in near), i
    assert set(four) == set(three)
    assert any(r.text != three[i].text for i, r in four.items())
    assert all(r.n_chars == len(r.text) for r in four.values())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = p.run(spark, FOLDER).collect()
    assert {r.doc_id for r in last} == set(four)
    for r in last:
        assert r.ids == " ".join(map(str, library.encode(four[r.doc_id].text, add_special_tokens=False).ids))


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
