"""Token counts and BPE against the library on given texts and on awkward ones."""

import hashlib
import json
import os
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docloom.llm import bpe, token_counts

AWKWARD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\nx\n", "x  y", "x  y", "it's WE'LL 'd", "<|endoftext|>", "a<|endoftext|>b <|endoftext|> c  <|startoftext|>",
    "é É ́x", "ΑΣ ΣΑΣ", "İstanbul", "1234 5,6", "日本語 テスト", "🙂🙂 🙂", "a\x1cb \x1c", "\t\ttab\r\n", "aaaaaaaaaaaa aaaaaaa", "x" * 5000, "ab " * 4000, "　 　",
]


def rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in docs] + [(10**6 + i, x) for i, x in enumerate(AWKWARD)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, sf_dir, name):
    path, given = public_tokenizers.path(name), rows(spark, sf_dir)
    docs = spark.createDataFrame([(*r, 7) for r in given], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, path).collect()}
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda x: len(model.encode(x))
    else:
        library = Tokenizer.from_file(path)
        count = lambda x: len(library.encode(x, add_special_tokens=False).ids)
    assert got == {i: (len((x or "").encode()), count(x or "")) for i, x in given}


def test_bpe_equals_the_library(spark, sf_dir):
    path, given = public_tokenizers.path("word_bpe_49k.json"), rows(spark, sf_dir)
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(*r, "x") for r in given], "doc_id long, text string, ids string")
    coded = bpe.encode_documents(docs, path)
    got = {r.doc_id: r for r in coded.collect()}
    for i, x in given:
        ids = library.encode(x or "", add_special_tokens=False).ids
        assert got[i].ids == " ".join(map(str, ids)), x
        assert got[i].n_tokens == len(ids)
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
    back = {r.doc_id: r.text for r in bpe.decode_documents(coded, path).collect()}
    assert back == {i: r.decoded for i, r in got.items()}


def test_digests(spark, tmp_path):
    os.makedirs(tmp_path / "t")
    docs = spark.createDataFrame([(1, None), (2, "Hello there"), (2, "Hello there")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "t/documents.parquet"))
    got = sorted(map(tuple, bpe.op10_bpe(spark, str(tmp_path / "t")).collect()))
    empty = hashlib.sha256(b"").hexdigest()
    assert got[0] == (1, 0, empty, empty) and got[1] == got[2]
    assert token_counts.op4_token_counts(spark, str(tmp_path / "t")).count() == 3


def test_every_token_of_the_vocabulary():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, model = Tokenizer.from_file(path), bpe.bpe_model(path)
    letters = {t.replace("</w>", "") for t in model.tokens.values() if not t.startswith("<|")}
    words = [a for a in letters if a.isascii() and a.isalpha()]
    for word in [*words, *(a + b for a, b in zip(words[::3], words[1::3], strict=False))]:
        assert model.piece(word) == library.encode(word, add_special_tokens=False).ids, word


def test_latin_texts_are_cut_as_the_library_cuts_them():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, model, rng = Tokenizer.from_file(path), bpe.bpe_model(path), random.Random(3)
    letters = [chr(c) for c in range(0x2100) if bpe.LATIN.fullmatch(chr(c))]
    assert model.plain and len(letters) > 600
    texts = [t for c in letters for t in (c, f"a{c}b", f"1{c}", f"x {c} y", f"{c}'s{c}")]
    texts += ["".join(rng.choice(letters + list("   '''sdtrevml") * 20) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    for text in texts:
        assert model.encode(text)[0] == " ".join(map(str, library.encode(text, add_special_tokens=False).ids)), text


def test_memo_forgets_by_age():
    made = []
    memo = bpe.Recent(lambda k: made.append(k) or (k,), 2)
    for keys in (["a", "b", "c"], ["a"], ["x" * 100], ["d", "e", "a"], ["b"]):
        assert memo.all(keys) == [(k,) for k in keys]
    assert made == ["a", "b", "c", "x" * 100, "d", "e", "b"]


def test_empty_table_and_unfit_vocabulary(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(empty, path).count() == 0
    assert token_counts.count_tokens(empty, path).count() == 0
    spec = json.load(open(path, encoding="utf-8"))
    spec["decoder"] = {"type": "ByteLevel"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.PrefixBpe(str(other))
