"""BPE encoding and decoding by dynamic programming over prefixes.

The BPE encoding of a prefix is fixed by its last token: it is the only token
that ends there, and that may follow the last token of the prefix before it.
So one token per prefix is stored, and back-pointers give the ids.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.vocab import Recent, by_bytes
from docloom.runtime import ship

#: Added to the last character of a word, to tell word-final symbols apart.
FINAL = 0x10000
MEMO_WORDS, MEMO_PIECES = 250_000, 150_000

#: The pre-tokenizer pattern that ``LATIN_WORDS`` stands for; files with another one go through the library. Fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Characters that composition leaves alone and whose lower case is one character, in all versions of Unicode:
# ASCII, Latin letters, dashes, quotes and currency signs.
LATIN = re.compile("[\\x00-\x7f\xa0-\u012f\u0131-\u0236\u2010-\u2027\u2030-\u205e\u20a0-\u20b5]*")
#: ``SPLIT`` on lower-case text of these.
_LETTER, _NUMBER, _SPACE = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \xa0"
LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")

_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b > 173))}

_MODELS: dict = {}


class PrefixBpe:
    """Exact BPE of a ``tokenizers`` vocabulary file.

    ``automaton`` yields, for each end position, every token that ends there
    (an automaton over the vocabulary); a pair test tells whether BPE of two
    tokens' joined text is just these two.
    """

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.tail = model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in model["vocab"].items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            new = model["vocab"][self._open(left) + right]
            ids = model["vocab"][left], model["vocab"][right]
            self.rank[ids] = rank
            self.made.setdefault(new, (rank, *ids))
        self._memo: dict[int, bool] = {}  # whether a pair of tokens stays a pair
        self.automaton = ahocorasick.Automaton()
        reached: dict[int, bool] = {}
        for new, (rank, left, right) in sorted(self.made.items(), key=lambda x: x[1][0]):
            reached[new] = reached.get(left, True) and reached.get(right, True) and not self._crossed(left, right, rank)
        for token, i in model["vocab"].items():
            form = self._form(token)
            if reached.get(i, len(form) == 1):
                self.automaton.add_word(form, (len(form), i))
        self.automaton.make_automaton()
        if spec.get("decoder") is not None or any(spec.get(x) is not None for x in ("truncation", "padding")):
            raise ValueError("only vocabularies without decoder, truncation and padding are handled")
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str if library.normalizer else lambda x: x
        self.pretokenize = library.pre_tokenizer.pre_tokenize_str
        self.plain = _plain(spec)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.added.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = Recent(lambda w: self._entry(self.word(byte_characters(w))), MEMO_WORDS)
        self.pieces = Recent(self._piece, MEMO_PIECES)

    def _open(self, left: str) -> str:
        return left[: -len(self.tail)] if self.tail and left.endswith(self.tail) else left

    def _form(self, token: str) -> str:
        """A token as a string with one character per initial symbol."""
        if self.tail and token.endswith(self.tail) and len(token) > len(self.tail):
            body = token[: -len(self.tail)]
            return body[:-1] + chr(ord(body[-1]) + FINAL)
        return token

    def _edge(self, token: int, side: int, until: float) -> list[tuple[int, float]]:
        """The symbols at one edge of a token while it is built, each with the rank that absorbs it."""
        chain = [(token, until)]
        while token in self.made:
            rank = self.made[token][0]
            token = self.made[token][side]
            chain.append((token, rank))
        return chain

    def _crossed(self, left: int, right: int, until: float = math.inf) -> bool:
        """Whether a merge across the border comes before both sides are done.

        Equal ranks mean equal pairs, which are merged from left to right.
        """
        for a, a_until in self._edge(left, 2, until):
            for b, b_until in self._edge(right, 1, until):
                rank = self.rank.get((a, b))
                if rank is not None and rank < a_until and rank <= b_until:
                    return rank < until
        return False

    def word(self, word: str) -> list[int]:
        """Token ids of one pre-token, given in the vocabulary's byte characters."""
        if self.tail:
            word = word[:-1] + chr(ord(word[-1]) + FINAL)
        n, pairs = len(word), self._memo
        last = [-1] * (n + 1)
        back = [0] * (n + 1)
        for end, (size, token) in self.automaton.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                pair = before << 32 | token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) > 2_000_000:
                        pairs.clear()
                    fits = pairs[pair] = not self._crossed(before, token)
                if not fits:
                    continue
            last[end], back[end] = token, start
        if last[n] < 0:
            raise ValueError(f"the vocabulary has no token for a part of {word!r}")
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def piece(self, text: str) -> list[int]:
        """Ids of a text, by the file's own normalizer, pre-tokenizer and added tokens."""
        ids: list[int] = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                ids.append(self.added[part])
            elif part:
                for word, _ in self.pretokenize(self.normalize(part)):
                    ids += self.word(word)
        return ids

    def _entry(self, ids: list[int]) -> tuple[str, str, int]:
        """(ids, tokens, their number); ids and tokens joined by a space."""
        return " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids]), len(ids)

    def _latin(self, text: str) -> list[tuple[str, str, int]] | None:
        """The entries of the pre-tokens of a text, if it may be cut by ``LATIN_WORDS``."""
        if not self.plain or LATIN.fullmatch(text) is None or any(x in text for x in self.added):
            return None
        return self.words.all(LATIN_WORDS.findall(text.lower()))

    def _piece(self, text: str) -> tuple[str, str, int]:
        found = self._latin(text)
        return self._entry(self.piece(text)) if found is None else _joined(found)

    def encode(self, text: str) -> tuple[str, str, int]:
        """(ids, tokens, their number) of a whole text.

        A Latin text is cut into pre-tokens at once; another one at spaces, as no
        pre-token holds one, and its other pieces go through the library's rules.
        """
        found = self._latin(text)
        if found is None:
            found = [x for x in self.pieces.all(text.replace("\n", " ").split(" ")) if x[2]]
        return _joined(found)

    def decode(self, ids: list[int]) -> str:
        """The text of ids when the file names no decoder: tokens joined by a space."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def _joined(found: list[tuple[str, str, int]]) -> tuple[str, str, int]:
    return " ".join([x[0] for x in found]), " ".join([x[1] for x in found]), sum([x[2] for x in found])


def byte_characters(text: str) -> str:
    """A text's UTF-8 bytes as the characters of byte-level vocabularies: visible Latin-1 stands for itself, the rest follows from 256 on."""
    return text if text.isascii() and text.isprintable() and " " not in text else text.encode().decode("latin-1").translate(_BYTES)


def _plain(spec: dict) -> bool:
    """Whether ``LATIN_WORDS`` of the lower-case text are the file's pre-tokens of a Latin text."""
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = [(x["type"], x.get("pattern"), x.get("content")) for x in normal.get("normalizers", [])]
    cuts = [{k: x.get(k) for k in ("type", "pattern", "behavior", "invert", "add_prefix_space", "use_regex")} for x in pre.get("pretokenizers", [])]
    return steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)] and cuts == [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True, "add_prefix_space": None, "use_regex": None},
        {"type": "ByteLevel", "pattern": None, "behavior": None, "invert": None, "add_prefix_space": False, "use_regex": False},
    ]


def bpe_model(path: str) -> PrefixBpe:
    """One model per file and Python worker."""
    if path not in _MODELS:
        _MODELS[path] = PrefixBpe(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all but the text) with ``ids``, ``n_tokens`` and ``decoded``.

    ``ids`` are the decimal ids joined by one space, which is compact and ready
    to be hashed or split; ``decoded`` is the decoded text. The vocabulary must
    drop white space (its pre-tokenizer yields no token with any).

    A null text counts as empty: no ids, an empty decoded text. Repeated rows and
    null keys give a row each. If a kept column is called like a result, the
    result wins. No shuffle; slices of a few MB of text are held at a time.
    """
    ship(docs.sparkSession)
    results = ["ids", "n_tokens", "decoded"]
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in [*results, text]]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe_model(vocabulary)
        for whole in batches:
            for batch in by_bytes(whole, text):
                rows = [model.encode(x or "") for x in batch.column(text).to_pylist()]
                ids, decoded, n = zip(*rows, strict=True)
                columns = [batch.column(c) for c in keep] + [pa.array(ids, pa.string()), pa.array(n, pa.int64()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, keep + results)

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["ids string", "n_tokens long", "decoded string"])
    return docs.select(*keep, F.col(text).cast("string").alias(text)).mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, vocabulary: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """``encoded`` with its ids decoded to column ``to`` (replaced if there). A null or empty ids column gives ''."""
    ship(encoded.sparkSession)
    keep = [c for c in encoded.columns if c != to]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe_model(vocabulary)
        for batch in batches:
            texts = [model.decode([int(i) for i in (x or "").split()]) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string())], [*keep, to])

    schema = ", ".join([f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep] + [f"`{to}` string"])
    return encoded.select(*keep).mapInArrow(decode, schema)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract query: digests of every document's ids and decoded text."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
