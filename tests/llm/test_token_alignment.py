"""Alignment of two tokenizers against whole texts encoded by the libraries and links counted one by one."""

import collections
import hashlib

import public_tokenizers
import pytest

from docloom.llm import token_alignment as ta
from docloom.runtime import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), ta._byte_level(A)[1]


def brute(libraries, texts):
    """Rows of the contract for whole texts, counts over all of them."""
    a, b, bytes_a = libraries
    per, held = [], collections.Counter()
    for text in texts:
        links, groups, ids_a, ids_b = collections.Counter(), [], [], []
        want = (" " + (text or "")).encode()
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            parts_a = [bytes_a[i] for i in ids_a]
            parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(parts_a) != want or b"".join(parts_b) != want:
                ids_a, ids_b = [], []
        if ids_a:
            ends = [set(), set()]
            for k, parts in enumerate((parts_a, parts_b)):
                at = 0
                for p in parts:
                    at += len(p)
                    ends[k].add(at)
            cuts = sorted(ends[0] & ends[1])
            at_a = at_b = i = j = 0
            for cut in cuts:
                x, y = i, j
                while at_a < cut:
                    at_a, i = at_a + len(parts_a[i]), i + 1
                while at_b < cut:
                    at_b, j = at_b + len(parts_b[j]), j + 1
                groups.append(",".join(map(str, ids_a[x:i])) + "|" + ",".join(map(str, ids_b[y:j])))
                links.update((p, q) for p in ids_a[x:i] for q in ids_b[y:j])
        held.update(links.keys())
        per.append((len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
    most = collections.Counter()
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    return [
        (n_a, n_b, n_g, sum(links.values()), sum(n for (p, q), n in links.items() if held[p, q] == most[p]), sum(n * held[k] for k, n in links.items()), text)
        for n_a, n_b, n_g, links, text in per
    ]


ODD = [
    None, "", " ", "\n", "  two  spaces ", "a\n b\t c", "x▁y", "▁", "<|endoftext|> is text", "<s>", "naïve café – ½ ﬁ", "日本語のテキスト", "🙂🙂 emoji 👩‍👩‍👧", "　wide space", "a\x1c b\x85 c",
    "the the the the the the the the the", "x" * 5000, "ab " * 3000, "don't we'll I'm", "été", "\x00", "1234567890 12 345", "tail ",
]


def test_odd_texts_nulls_and_repeated_rows(spark, libraries):
    texts = ODD + ["the cat", "the cat"]
    rows = [(None if i == 8 else i, t, 1) for i, t in enumerate(texts)] + [(3, "the cat", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, range int").repartition(3)
    got = ta.align_tokenizers(docs, A, B).collect()
    assert len(got) == len(rows)
    want = collections.Counter(zip([r[0] for r in rows], brute(libraries, [r[1] for r in rows]), strict=True))
    assert collections.Counter((r[0], tuple(r[1:])) for r in got) == want
    assert ta.align_tokenizers(docs.limit(0), A, B).count() == 0


def test_pair_table_and_small_ranges(spark, libraries, monkeypatch):
    texts = ["the cat sat on the mat the end", "the dog", "a cat", "unhappily the"] * 10
    monkeypatch.setattr(ta, "RANGE", 16)
    monkeypatch.setattr(ta, "WORDS", 3)
    held, lexicon, found = ta._Range(), ta.Lexicon(A, B), collections.Counter()
    for i in range(0, 40, 8):
        if held.documents == 16:
            for pairs, plane, edges, positions in held.containers(lexicon):
                bits, dense = ta._packed(edges, positions)
                assert len(pairs) == len(bits) == len(dense)
                for p, n in zip(pairs.tolist(), (edges[1:] - edges[:-1]).tolist(), strict=True):
                    found[p] += n << max(plane - 1, 0)
            held = ta._Range()
            lexicon.trim()
        ta._documents(lexicon, held, texts[i : i + 8])
    for pairs, plane, edges, _ in held.containers(lexicon):
        for p, n in zip(pairs.tolist(), (edges[1:] - edges[:-1]).tolist(), strict=True):
            found[p] += n << max(plane - 1, 0)
    links = sum(r[3] for r in brute(libraries, texts))
    assert sum(found.values()) == links
    monkeypatch.undo()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = ta.count_pairs(ta.index_links(docs, A, B)).collect()
    assert {r.pair: r.n_links for r in pairs} == dict(found)
    assert sum(r.n_links for r in pairs) == links and max(r.n_documents for r in pairs) == 30


def test_query_equals_brute_force(spark, libraries):
    sf_dir = "/root/testdata/sf0.01"  # enough documents for containers of both forms
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r[1:]) for r in ta.op12_token_alignment(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r, want in zip(rows, brute(libraries, [r.text for r in rows]), strict=True):
        digest = hashlib.sha256(want[6].encode()).hexdigest() if want[6] else ""
        assert got[r.doc_id] == (*want[:6], digest)
