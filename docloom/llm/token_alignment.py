"""Alignment of two tokenizers by inverted pair bitmaps.

Both tokenizers cut a text at byte offsets; where both cut, a group ends, and every
token of one is linked to every token of the other in its group. For each linked
pair of ids there is a bitmap of the documents that hold it, and planes with the
bits of how often they hold it beyond once. Documents are numbered in ranges of
RANGE; a bitmap has a container for each range, as positions or as bits, whichever
is less. Containers of slices of a range are OR-ed where they are made; those of
different ranges share no document, so the OR of a pair's bitmap is the list of
its containers, and its count the sum of their popcounts.

Counts go back to the containers (the postings) by pair, and these, dealt out by
range, return the scores of each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.vocab import by_bytes, safe_pieces
from docloom.runtime import materialize, ship

RANGE = 4096  # documents of a container
ENTRIES = 3_000_000  # a range is closed early when it has so many (document, pair) entries
RUN_CHARS = 20_000  # of words that are encoded as one text, about
WORDS = 400_000  # words that a worker remembers from range to range, about

_READY: dict = {}


def _byte_level(path: str):
    """(encode a batch of texts with a space in front, bytes of each id) of a byte-level tokenizers file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if "ByteLevel" not in repr(tokenizer.pre_tokenizer) or tokenizer.normalizer is not None:
        raise ValueError(f"{path} isn't a byte-level tokenizer without normalizer")
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    letter = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(visible)))}
    special = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    tokens = [special[i] if i in special else bytes(map(letter.__getitem__, tokenizer.id_to_token(i))) for i in range(tokenizer.get_vocab_size())]
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], tokens


def _pieces(path: str):
    """(encode a batch, bytes of each id) of a sentencepiece model, which adds the texts' first space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in t.lstrip("▁") for t in texts):
        raise ValueError(f"{path} has pieces that run from a visible character into a space, so words don't stand alone")
    tokens = [bytes([int(t[3:5], 16)]) if model.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(texts)]
    lone = model.encode("a ")[len(model.encode("a")) :]  # a space with nothing behind it, to which the empty text gives no token
    return lambda texts: [ids if len(t) > 1 else lone for t, ids in zip(texts, model.encode([t[1:] for t in texts], num_threads=1), strict=True)], tokens


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... sizes[i] of them, for each i in turn."""
    total = int(sizes.sum())
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(total)


class Lexicon:
    """What is known of words (a space and what follows, up to the next safe space): counts, groups and linked pairs.

    Neither tokenizer lets a token run into such a space, so words are encoded alone and links never leave them.
    """

    def __init__(self, a_path: str, b_path: str):
        self.encode_a, self.bytes_a = _byte_level(a_path)
        self.encode_b, self.bytes_b = _pieces(b_path)
        self.length_a, self.length_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups = pa.array([], pa.large_string())
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links; -1 where a tokenizer changes the word
        self.first = np.zeros(1, np.int64)  # the pairs of word i are first[i]:first[i + 1]
        self.pair = np.zeros(0, np.int32)  # numbers of pairs
        self.times = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)
        self.pair_number: dict[int, int] = {}

    def trim(self) -> None:
        """Keep words that were used again since they were learned or last kept."""
        if len(self.number) <= WORDS:
            return
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > WORDS:
            self.forget()
            return
        names = list(self.number)
        sizes = np.diff(self.first)[keep]
        flat = _spread(self.first[keep], sizes)
        self.pair, self.times = self.pair[flat], self.times[flat]
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.counts, self.uses = self.counts[keep], np.zeros(len(keep), np.int64)
        self.groups = self.groups.take(pa.array(keep))
        self.number = {names[i]: k for k, i in enumerate(keep)}

    def learn(self, words: list[str]) -> None:
        """Encode new words, many in one text; where a tokenizer changes something, each alone."""
        if not words:
            return
        runs, size = [[]], 0
        for w in sorted(words, key=lambda w: not w or w[-1].isspace()):  # a space may follow any other word
            if size + len(w) > RUN_CHARS or not w or w[-1].isspace():
                runs.append([])
                size = 0
            runs[-1].append(w)
            size += len(w) + 1
        runs = [r for r in runs if r]
        texts = [" " + " ".join(r) for r in runs]
        found = list(zip(runs, texts, self.encode_a(texts), self.encode_b(texts), strict=True))
        sound = [self._kept(t, b) for _, t, _, b in found]
        apart = [w for (run, *_), ok in zip(found, sound, strict=True) if not ok for w in run]
        if apart:
            texts = [" " + w for w in apart]
            found = [f for f, ok in zip(found, sound, strict=True) if ok] + [([w], t, a, b) for w, t, a, b in zip(apart, texts, self.encode_a(texts), self.encode_b(texts), strict=True) if self._kept(t, b)]
        kept = [w for run, *_ in found for w in run]
        spoilt = set(apart).difference(kept)
        if kept:
            self._align(kept, *(np.fromiter((i for f in found for i in f[k]), np.int64) for k in (2, 3)))
        self._append(list(spoilt), np.full((len(spoilt), 4), -1, np.int64), pa.array([""] * len(spoilt), pa.large_string()), np.zeros(len(spoilt), np.int64))

    def _kept(self, text: str, ids: list[int]) -> bool:
        return b"".join(map(self.bytes_b.__getitem__, ids)) == text.encode()

    def _append(self, words: list[str], counts: np.ndarray, groups: pa.Array, sizes: np.ndarray) -> None:
        for i, w in enumerate(words, len(self.number)):
            self.number[w] = i
        self.counts = np.concatenate([self.counts, counts])
        self.groups = pa.concat_arrays([self.groups, groups])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])

    def _align(self, words: list[str], a: np.ndarray, b: np.ndarray) -> None:
        """Groups and pairs of words one behind another, given all their tokens."""
        end = np.cumsum([len(w.encode()) + 1 for w in words])
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)  # among them are all ends of words
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        word = np.searchsorted(end, both)  # of each group
        each = lambda weights=None: np.bincount(word, weights, minlength=len(words)).astype(np.int64)
        counts = np.stack([each(in_a), each(in_b), each(), each(in_a * in_b)], axis=1)
        first_b = np.cumsum(in_b) - in_b
        code = (np.repeat(a, in_b[group_a]) << 32) | b[_spread(first_b[group_a], in_b[group_a])]
        distinct, inverse = np.unique(code, return_inverse=True)
        numbers = np.array([self.pair_number.setdefault(c, len(self.pair_number)) for c in distinct.tolist()], np.int64)
        key, times = np.unique((np.repeat(word[group_a], in_b[group_a]) << 32) | numbers[inverse], return_counts=True)
        self.pair, self.times = np.concatenate([self.pair, (key & 0xFFFFFFFF).astype(np.int32)]), np.concatenate([self.times, times])
        groups = pc.binary_join_element_wise(_joined(_decimal(a), in_a, ","), _joined(_decimal(b), in_b, ","), pa.scalar("|", pa.large_string()))
        self._append(words, counts, _joined(groups, counts[:, 2], ";"), np.bincount(key >> 32, minlength=len(words)))


def _decimal(ids: np.ndarray) -> pa.Array:
    return pa.array(ids).cast(pa.large_string())


def _joined(texts: pa.Array, sizes: np.ndarray, by: str) -> pa.Array:
    """sizes[i] of the texts each, joined."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), texts), pa.scalar(by, pa.large_string()))


class _Range:
    """Entries (pair, document, times) of one range of documents."""

    def __init__(self):
        self.documents = self.entries = 0
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, lexicon: Lexicon, position: np.ndarray, word: np.ndarray, count: np.ndarray) -> None:
        """Words of a slice's documents; equal entries of a document become one."""
        sizes = np.diff(lexicon.first)[word]
        flat = _spread(lexicon.first[word], sizes)
        key = lexicon.pair[flat].astype(np.int64) * RANGE + np.repeat(position, sizes)
        times = lexicon.times[flat] * np.repeat(count, sizes)
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.keys.append(key[first])
        self.times.append(np.add.reduceat(times, first))
        self.entries += len(first)

    def containers(self, lexicon: Lexicon) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """(pair of each container, plane, its entries as offsets, positions); plane 0 is presence, plane k bit k - 1 of the times beyond one."""
        if not self.keys:
            return
        key, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(key, kind="stable")  # slices hold different documents: the OR of their containers is their merge
        key, times = key[order], times[order] - 1
        codes = np.fromiter(lexicon.pair_number, np.int64, len(lexicon.pair_number))
        plane = 0
        while plane == 0 or (times >> (plane - 1)).any():
            held = key if plane == 0 else key[(times >> (plane - 1) & 1) > 0]
            pair = held // RANGE
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))[: len(held)]
            yield codes[pair[first]], plane, np.append(first, len(held)), (held % RANGE).astype(np.uint16)
            plane += 1


def _packed(edges: np.ndarray, positions: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Each container as positions (two bytes each) or as RANGE bits, and which are bits."""
    raw = positions.astype("<u2").tobytes()
    cut = edges.tolist()
    out = [raw[2 * x : 2 * y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
    dense = np.diff(edges) > RANGE // 16
    for i in np.flatnonzero(dense):
        bits = np.zeros(RANGE, np.uint8)
        bits[positions[edges[i] : edges[i + 1]]] = 1
        out[i] = np.packbits(bits, bitorder="little").tobytes()
    return out, dense


_DOCUMENT = {"position": pa.int32(), "key": None, "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string()}
_POSTING = {"pair": pa.int64(), "plane": pa.int32(), "dense": pa.bool_(), "bits": pa.binary()}


def index_links(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of two kinds for each ``range`` of documents, encoded where they are read.

    Documents: position in the range, key, n_a, n_b, n_groups, n_links and groups
    (``a1,a2|b1;a3|b2`` in ids). Postings: pair (id of A * 2**32 + id of B), plane, and
    a container as positions or bits; their position is null.
    """
    ship(docs.sparkSession)
    kinds = {"position": "int", "key": docs.schema[key].dataType.simpleString(), "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "string", "pair": "long", "plane": "int", "dense": "boolean", "bits": "binary"}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _READY.get((a_path, b_path))
        if lexicon is None:
            lexicon = _READY[a_path, b_path] = Lexicon(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        held = _Range()

        def batch_of(n: int, **columns) -> pa.RecordBatch:
            fields = {"range": pa.int64()} | _DOCUMENT | {"key": key_type} | _POSTING
            values = {"range": np.full(n, number, np.int64)} | columns
            return pa.RecordBatch.from_arrays([pa.array(values[c], kind) if c in values and not isinstance(values[c], pa.Array) else values.get(c, pa.nulls(n, kind)) for c, kind in fields.items()], list(fields))

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            for pairs, plane, edges, positions in held.containers(lexicon):
                bits, dense = _packed(edges, positions)
                for i in range(0, len(pairs), 20_000):
                    part = slice(i, i + 20_000)
                    n = len(pairs[part])
                    yield batch_of(n, pair=pairs[part], plane=np.full(n, plane, np.int32), dense=dense[part], bits=pa.array(bits[part], pa.binary()))
            number, held = number + 1, _Range()
            lexicon.trim()

        key_type = None
        for whole in batches:
            key_type = whole.schema.field("key").type
            for piece in by_bytes(whole, "text"):
                for i in range(0, piece.num_rows, RANGE):
                    batch = piece.slice(i, RANGE)
                    if held.documents + batch.num_rows > RANGE or held.entries > ENTRIES:
                        yield from close()
                    yield batch_of(batch.num_rows, key=batch.column("key"), **_documents(lexicon, held, batch.column("text").to_pylist()))
        if held.documents:
            yield from close()

    chosen = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(index, "range long, " + ", ".join(f"{c} {k}" for c, k in kinds.items()))


def _words(text: str) -> list[str]:
    """A space and the text, cut before safe spaces; each word stands for a space and itself."""
    head, *rest = safe_pieces(" " + text)
    return [head[1:], *rest] if head else rest


def _documents(lexicon: Lexicon, held: _Range, texts: list[str | None]) -> dict:
    """Counts and groups of a slice's documents; their words go into the range."""
    cut = [_words(t) if t else [] for t in texts]
    every = set().union(*cut)
    lexicon.learn(list(every.difference(lexicon.number)))
    n, first = len(texts), held.documents
    held.documents += n
    sizes = np.array([len(words) for words in cut], np.int64)
    number = lexicon.number
    flat = np.fromiter((i for words in cut for i in map(number.__getitem__, words)), np.int64, int(sizes.sum()))
    of = np.repeat(np.arange(n), sizes)
    spoilt = np.zeros(n, bool)
    spoilt[of[lexicon.counts[flat, 0] < 0]] = True
    flat, of, sizes = flat[~spoilt[of]], of[~spoilt[of]], np.where(spoilt, 0, sizes)
    key, times = np.unique(of * len(lexicon.uses) + flat, return_counts=True)
    document, word = key // max(len(lexicon.uses), 1), key % max(len(lexicon.uses), 1)
    np.add.at(lexicon.uses, word, times)
    held.add(lexicon, first + document, word, times)
    counts = np.zeros((n, 4), np.int64)
    np.add.at(counts, document, lexicon.counts[word] * times[:, None])
    groups = _joined(lexicon.groups.take(pa.array(flat)), sizes, ";")
    return {"position": np.arange(first, first + n, dtype=np.int32), "n_a": counts[:, 0], "n_b": counts[:, 1], "n_groups": counts[:, 2], "n_links": counts[:, 3], "groups": groups.cast(pa.string())}


def count_pairs(index: DataFrame) -> DataFrame:
    """``pair``, ``a``, ``b``, ``n_documents``, ``n_links`` and ``best`` (no pair of this A id is in more documents), by popcounts."""
    bits = F.when(F.col("dense"), F.expr("bitmap_count(bits)")).otherwise(F.octet_length("bits") / 2).cast("long")
    weighed = F.when(F.col("plane") < 2, bits).otherwise(bits * F.expr("shiftleft(1L, plane - 1)"))
    found = index.where("pair IS NOT NULL").groupBy("pair").agg(F.sum(F.when(F.col("plane") == 0, bits)).alias("n_documents"), F.sum(weighed).alias("n_links"))
    found = found.withColumns({"a": F.shiftright("pair", 32).cast("int"), "b": F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int")})
    most = found.groupBy("a").agg(F.max("n_documents").alias("most"))  # as many rows as A has ids, at most
    return found.join(F.broadcast(most), "a").select("pair", "a", "b", "n_documents", "n_links", (F.col("n_documents") == F.col("most")).alias("best"))


def score_documents(index: DataFrame) -> DataFrame:
    """``range``, ``position``, ``n_best`` and ``count_sum``: postings with their pair's count, summed by document."""
    counts = count_pairs(index).select("pair", "n_documents", "best")
    postings = index.where("pair IS NOT NULL").select("range", "pair", "plane", "dense", "bits").join(counts, "pair").drop("pair").repartition("range")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # a few ranges: what is dealt to one task
        for batch in batches:
            number, plane, dense, count, best = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("range", "plane", "dense", "n_documents", "best"))
            bits = batch.column("bits").to_pylist()
            weight = np.left_shift(1, np.maximum(plane.astype(np.int64) - 1, 0))
            values = np.stack([weight * best, weight * count])
            for r in np.unique(number).tolist():
                total = sums.setdefault(r, np.zeros((2, RANGE), np.int64))
                few, many = np.flatnonzero((number == r) & ~dense), np.flatnonzero((number == r) & dense)
                position = np.frombuffer(b"".join([bits[i] for i in few]), "<u2")
                size = np.array([len(bits[i]) // 2 for i in few], np.int64)
                for k in (0, 1):
                    np.add.at(total[k], position, np.repeat(values[k][few], size))
                for i in range(0, len(many), 256):
                    part = many[i : i + 256]
                    held = np.unpackbits(np.frombuffer(b"".join([bits[j] for j in part]), np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
                    total += values[:, part] @ held
        for r, total in sums.items():
            at = np.flatnonzero(total[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r, np.int64)), pa.array(at.astype(np.int32)), pa.array(total[0][at]), pa.array(total[1][at])], ["range", "position", "n_best", "count_sum"])

    return postings.mapInArrow(score, "range long, position int, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id", groups: Callable[[Column], Column] = lambda g: g) -> DataFrame:
    """``key``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every document.

    ``a_path``: a byte-level tokenizers ``.json``, for a space and the text;
    ``b_path``: a sentencepiece ``.model`` that leaves texts as they are and adds
    the space itself. n_best counts links whose pair is in more documents than any
    other pair of its A id (ties included); count_sum adds, over the links, in how
    many documents the pair is. ``groups`` is applied to the column of groups before
    it is stored.

    Texts that are null or empty, or that a tokenizer doesn't give back byte by byte,
    have no tokens: zeros and an empty ``groups``, and no pair counts them. A
    repeated row is a document of its own; a null key gives a row. Other columns
    are ignored.
    """
    index = index_links(docs, a_path, b_path, text, key)
    index = materialize(index.withColumn("groups", groups(F.col("groups"))))
    found = index.where("position IS NOT NULL").join(score_documents(index), ["range", "position"], "left")
    return found.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Contract query: both tokenizers over every document; the groups are kept as a digest."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    digest = lambda g: F.when(g == "", "").otherwise(F.sha2(g, 256))
    found = align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), groups=digest)
    return found.withColumnRenamed("groups", "groups_sha256")
