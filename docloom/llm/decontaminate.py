"""Benchmark decontamination: random-walk embedding, bit-sampling LSH, exact edit distance.

Texts are sequences of words (runs of letters and digits, ASCII case folded). A
random walk reads a word at each step and moves on, or not, by a bit hashed from
step and word (CGK). Sequences a few edits apart fall back in step after each
edit, so they agree in many steps: edit distance becomes Hamming distance. A
repetition of the LSH samples two steps of a walk of its own; windows that share
both words with a benchmark item are candidates for it, and the edit distance
of item and window is then computed exactly.

Windows have the size of an item (one of a grid of size classes). A window is
walked only if it holds as many of the benchmark's word pairs as any match must:
an edit breaks two pairs at most. That test uses a bitmap of fixed size, is the
same for all items and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrowtext import FOLD, NON_ALNUM, U64, Words, mix, windows, words
from docloom.llm.vocab import by_bytes
from docloom.runtime import materialize, ship

EDIT_SHARE = 0.1  # edits allowed, as a share of an item's words; one at least
EDITED_FROM = 5  # words of an item that may be edited; shorter ones are found as they stand
REPEATS, SAMPLES = 32, 2
GRID = 1.2
BITS = 1 << 23  # of each bitmap
TASK_PAIRS, MOST_TASKS = 2_000, 20_000  # candidates that a task verifies; beyond so many tasks each takes more
CELLS = 1 << 15  # words of the texts that are compared side by side, padding included


def edits(n):
    """Edits allowed for an item of n words."""
    return np.maximum(1, np.floor(EDIT_SHARE * np.asarray(n))).astype(np.int64)


def class_of(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, EDITED_FROM)) / np.log(GRID) + 1e-9).astype(np.int64)


def class_range(c: int) -> tuple[int, int]:
    """The least and the greatest number of words of a size class."""
    n = np.arange(EDITED_FROM, int(GRID ** (c + 1)) + 2)
    n = n[class_of(n) == c]
    return int(n[0]), int(n[-1])


def pairs_needed(c: int) -> int:
    """Word pairs that a match of an item of this size class keeps at least.

    The least over all lengths: an edit more is allowed at every tenth word, so a
    longer item may keep fewer pairs.
    """
    low, high = class_range(c)
    n = np.arange(low, high + 1)
    return int((n - 1 - 2 * edits(n)).min())


def folded(column: pa.Array) -> Words:
    return words(column, NON_ALNUM, FOLD)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (mix(h, 31) & U64(BITS - 1)).astype(np.int64)


def _samples(c: int, repeat: int) -> np.ndarray:
    """The steps that a repetition samples, in order."""
    low, _ = class_range(c)
    seed = mix(np.arange(64, dtype=U64) + U64(c * 4096 + repeat * 64 + 7), 41)
    return np.sort(list(dict.fromkeys((seed % U64(2 * low)).tolist()))[:SAMPLES])


def walk_keys(h: np.ndarray, start: np.ndarray, stop: np.ndarray, c: int) -> np.ndarray:
    """(REPEATS, windows) LSH keys of the windows that begin at ``start`` and read nothing from ``stop`` on."""
    chosen = [_samples(c, r) for r in range(REPEATS)]
    steps = 1 + max(int(x[-1]) for x in chosen)
    repeat = np.arange(REPEATS, dtype=U64)[:, None]
    at = np.repeat(start[None, :], REPEATS, axis=0)
    key = np.repeat(U64(c * 1000) + repeat, len(start), axis=1)
    padded = np.append(h, U64(0))
    for j in range(steps):
        symbol = np.where(at < stop, padded[np.minimum(at, len(h))], U64(0))
        sampled = [r for r in range(REPEATS) if j in chosen[r]]
        if sampled:
            key[sampled] = mix(key[sampled] ^ symbol[sampled], 43)
        turn = mix(U64(j) + (repeat << U64(32)), 42) | U64(1)
        at += ((symbol * turn) >> U64(63)).astype(np.int64)
    return key


def distances(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Least word edits between each item and any part of its text; pairs are computed side by side."""
    n, m = np.array([len(x) for x in items]), np.array([len(x) for x in texts])
    a = np.zeros((len(items), n.max(initial=0)), dtype=U64)
    b = np.zeros((len(items), m.max(initial=0)), dtype=U64)
    for i, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    inside = np.arange(b.shape[1])[None, :] < m[:, None]
    column = np.arange(b.shape[1] + 1)
    d = np.zeros((len(items), b.shape[1] + 1), np.int64)
    out = np.zeros(len(items), np.int64)
    for k in range(a.shape[1]):
        nxt = np.empty_like(d)
        nxt[:, 0] = k + 1
        nxt[:, 1:] = np.minimum(d[:, :-1] + ((a[:, k, None] != b) | ~inside), d[:, 1:] + 1)
        d = np.minimum.accumulate(nxt - column, axis=1) + column
        ended = n == k + 1
        if ended.any():
            valid = np.concatenate([np.ones((len(items), 1), bool), inside], axis=1)
            out[ended] = np.where(valid, d, 1 << 40).min(axis=1)[ended]
    return out


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, size_class) of the items that may be edited."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                w = folded(batch.column("text"))
                n = np.diff(w.rows)
                keep = np.flatnonzero(n >= EDITED_FROM)
                lists = [w.hashes[w.rows[i] : w.rows[i + 1]].view(np.int64) for i in keep]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(keep)), pa.array(lists, pa.list_(pa.int64())), pa.array(class_of(n[keep]), pa.int64())], ["item_id", "words", "size_class"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(emit, "item_id long, words array<long>, size_class long")


def _short_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, size, key) of the items of one to four words: the hash of all their words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                w = folded(batch.column("text"))
                n = np.diff(w.rows)
                for size in range(1, EDITED_FROM):
                    key, at = windows(w, size)
                    row = w.row_of()[at]
                    alone = n[row] == size
                    yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(row[alone])), pa.array(np.full(alone.sum(), size, np.int64)), pa.array(key[alone].view(np.int64))], ["item_id", "size", "key"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(emit, "item_id long, size long, key long")


def _short_hits(docs: DataFrame, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """(doc_id, key): windows of these sizes that a short item may be, each once for a row."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # 1 MB

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(shared.value).view(bool)
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                w = folded(batch.column("text"))
                for size in sizes:
                    key, at = windows(w, size)
                    known = held[_bucket(key)]
                    found = np.unique(np.stack([w.row_of()[at[known]].astype(U64), key[known]], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(found[:, 0].astype(np.int64))), pa.array(found[:, 1].copy().view(np.int64))], ["doc_id", "key"])

    return docs.mapInArrow(emit, "doc_id long, key long")


def _item_keys(items: DataFrame) -> DataFrame:
    """(kind, value, item_id): 'k' LSH keys of items, 'p' bitmap places of their word pairs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size_class = np.array(batch.column("item_id").to_pylist(), dtype=object), batch.column("size_class").to_numpy()
            seqs = [x.values.to_numpy().view(U64) for x in batch.column("words")]
            if not seqs:
                continue
            rows = np.cumsum([0, *map(len, seqs)])
            h = np.concatenate(seqs)
            pairs, _ = windows(Words(h, h, h, rows), 2)
            places = np.unique(_bucket(pairs))
            yield pa.RecordBatch.from_arrays([pa.array(["p"] * len(places)), pa.array(places), pa.nulls(len(places), pa.int64())], ["kind", "value", "item_id"])
            for c in np.unique(size_class):
                which = np.flatnonzero(size_class == c)
                keys = walk_keys(h, rows[which], rows[which + 1], int(c))
                yield pa.RecordBatch.from_arrays([pa.array(["k"] * keys.size), pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(ids[which], REPEATS).tolist(), pa.int64())], ["kind", "value", "item_id"])

    return items.mapInArrow(emit, "kind string, value long, item_id long")


def _regions(docs: DataFrame, classes: list[int], pair_bits: np.ndarray, key_bits: np.ndarray) -> DataFrame:
    """(region, doc_id, keys, around): runs of windows whose LSH keys an item may have, and their words.

    Overlapping windows of a document make one region, so its words are kept once.
    """
    shared = docs.sparkSession.sparkContext.broadcast((pair_bits, key_bits))  # 2 MB, whatever the benchmark's size

    def hits_of(w: Words, pair_map: np.ndarray, key_map: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        pairs, at = windows(w, 2)
        known = np.zeros(len(w.hashes) + 1, np.int64)
        known[at + 1] = pair_map[_bucket(pairs)]
        if not known.any():
            return []
        count = np.cumsum(known)
        last = np.repeat(w.rows[1:], np.diff(w.rows))
        first = np.repeat(w.rows[:-1], np.diff(w.rows))
        out = []
        for c in classes:
            _, high = class_range(c)
            need, reach, slack = pairs_needed(c), high + int(edits(high)), 2 * int(edits(high))
            end = np.minimum(np.arange(len(w.hashes)) + reach, last)
            starts = np.flatnonzero(count[np.maximum(end - 1, 0)] - count[: len(w.hashes)] >= max(need, 1))
            for a in range(0, len(starts), 4096):
                start = starts[a : a + 4096]
                keys = walk_keys(w.hashes, start, last[start], c)
                repeat, i = np.nonzero(key_map[_bucket(keys)])
                s = start[i]
                out.append((keys[repeat, i], np.maximum(s - slack, first[s]), np.minimum(s + high + slack, last[s])))
        return out

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair_map, key_map = (np.unpackbits(x).view(bool) for x in shared.value)
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                w = folded(batch.column("text"))
                found = hits_of(w, pair_map, key_map)
                if not found:
                    continue
                keys, starts, stops = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(keys):
                    continue
                order = np.argsort(starts, kind="stable")
                keys, starts, stops = keys[order], starts[order], stops[order]
                row = w.row_of()[starts]
                reach = np.maximum.accumulate(stops)  # rows follow each other, so a reach never passes into the next row's start
                new = np.ones(len(keys), bool)
                new[1:] = (row[1:] != row[:-1]) | (starts[1:] >= reach[:-1])
                edge = np.append(np.flatnonzero(new), len(keys))
                regions, ids, lists, around = [], [], [], []
                doc = batch.column("doc_id").to_pylist()
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    x, y, r = int(starts[a]), int(stops[a:b].max()), int(row[a])
                    mark = np.array([(doc[r] if doc[r] is not None else -(1 << 62)) & 0xFFFFFFFFFFFFFFFF, x - w.rows[r]], dtype=U64)
                    regions.append(int((mix(mark[:1], 51) ^ mix(mark[1:], 52) ^ w.hashes[x : x + 1]).view(np.int64)[0]))
                    ids.append(doc[r])
                    lists.append(np.unique(keys[a:b]).view(np.int64))
                    around.append(w.hashes[x:y].view(np.int64))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(regions, pa.int64()), pa.array(ids, pa.int64()), pa.array(lists, longs), pa.array(around, longs)], ["region", "doc_id", "keys", "around"])

    return docs.mapInArrow(emit, "region long, doc_id long, keys array<long>, around array<long>")


def _bitmap(places) -> np.ndarray:
    bits = np.zeros(BITS, bool)
    bits[np.fromiter(places, np.int64)] = True
    return np.packbits(bits)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_edits) for every document that holds a benchmark item.

    An item is held if some part of the text is at most ``edits(words)`` word
    insertions, deletions or replacements away; ``n_edits`` is the least number
    found. ``docs(doc_id, text)``, ``benchmark(item_id, text)``.

    Items of under EDITED_FROM words must stand in the text as they are (no edits).
    Null and empty texts hold and are nothing. Repeated rows count as one document, equal items each for themselves;
    a null id is reported as null. Other columns are ignored. Texts are not
    shuffled; what is broadcast has a fixed size.
    """
    spark = docs.sparkSession
    ship(spark)
    items = materialize(_items(benchmark))
    facts = materialize(_item_keys(items))
    classes = [r.size_class for r in items.select("size_class").distinct().orderBy("size_class").collect()]  # about log(longest item) values
    pair_bits = _bitmap(r.value for r in facts.where("kind = 'p'").select("value").distinct().toLocalIterator())  # BITS values at most
    keys = facts.where("kind = 'k'").select(F.col("value").alias("key"), "item_id").distinct()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(batch.column("key").to_numpy().view(U64)))], ["place"])

    place_of = lambda frame: _bitmap(r.place for r in frame.select("key").mapInArrow(places, "place long").distinct().toLocalIterator())
    key_bits = place_of(keys)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    regions = materialize(_regions(own, classes, pair_bits, key_bits))
    hits = materialize(regions.select("region", F.explode("keys").alias("key")).join(keys, "key").select("region", "item_id").distinct())
    tasks = min(MOST_TASKS, 1 + hits.count() // TASK_PAIRS)  # few bytes, but much to compute for each
    pairs = hits.join(regions.select("region", "doc_id", "around"), "region")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _side_by_side(whole):
                item = [x.values.to_numpy().view(U64) for x in batch.column("words")]
                d = distances(item, [x.values.to_numpy().view(U64) for x in batch.column("around")])
                keep = pa.array(d <= edits([len(x) for x in item]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(keep), batch.column("item_id").filter(keep), pa.array(d).filter(keep)], ["doc_id", "item_id", "n_edits"])

    tested = pairs.join(items.select("item_id", "words").dropDuplicates(["item_id", "words"]), "item_id").repartition(tasks, "region", "item_id").mapInArrow(verify, "doc_id long, item_id long, n_edits long")
    short = materialize(_short_items(benchmark).distinct())
    sizes = [r.size for r in short.select("size").distinct().orderBy("size").collect()]  # four at most
    if sizes:
        verbatim = _short_hits(own, sizes, place_of(short)).distinct().join(short, "key").select("doc_id", "item_id", F.lit(0).cast("long").alias("n_edits"))
        tested = tested.unionByName(verbatim)
    return tested.groupBy("doc_id", "item_id").agg(F.min("n_edits").alias("n_edits"))


def _side_by_side(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of candidates, shortest texts first, whose texts padded to the longest have about CELLS words."""
    sizes = np.array([len(x) for x in batch.column("around")], np.int64)
    order = np.argsort(sizes, kind="stable")
    batch, sizes = batch.take(pa.array(order)), sizes[order].tolist()
    start = longest = 0
    for i, n in enumerate(sizes):
        if i > start and max(longest, n) * (i - start + 1) > CELLS:
            yield batch.slice(start, i - start)
            start, longest = i, 0
        longest = max(longest, n)
    if start < len(sizes):
        yield batch.slice(start)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns stay, and so do rows with a null id."""
    leaks = find_leaks(docs, benchmark).where("doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark items that each document holds."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
