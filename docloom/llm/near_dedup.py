"""MinHash near-dedup with dart throwing.

A document is a weighted set of five-word shingles. Every shingle has hashed
darts: points of a Poisson process of rate one over weight x rank, the same in
every document. A dart hits a document if its weight coordinate lies below the
shingle's weight there. Each dart has a coordinate of the signature; per
coordinate the dart of least rank stays. Ranks are searched from zero until all
coordinates are hit, so a signature costs about the number of shingles plus
k log k, not their product.

Signatures are cut into bands; documents that share a band's key are candidates
and their similarity is then computed exactly. In a bucket, members are first
compared to two hubs, of which one is the member that shares the most buckets
with others, so stands in the middle of its family. Buckets whose members are
not one class by then are open. Their members are compared to all others that
may reach the threshold at all: sets that do so share one of their rarest
shingles (prefix filtering), and only pairs of different classes are made. So
each pair of a bucket is compared, or in one class anyway, or below the
threshold by its bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrowtext import U64, Words, mix, to_rows, windows, words
from docloom.llm.substring_dedup import content_keys
from docloom.llm.vocab import by_bytes
from docloom.runtime import materialize, ship

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
SPREAD = 200_000  # elements of an Arrow batch, about

_CELL = 12  # darts of a cell, at most; the chance of more is below 1e-9
_TABLE = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, _CELL)])))


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every row: hash, row and count, sorted by row, then hash.

    A text of fewer words than ``size`` has one shingle of all its words.
    """
    hashes, at = windows(w, size)
    row = w.row_of()[at]
    n = np.diff(w.rows)
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        key, _ = content_keys(w)
        hashes, row = np.concatenate([hashes, key[few]]), np.concatenate([row, few])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return hashes[first], row[first], np.diff(np.append(first, len(hashes)))


def signatures(hashes: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """(n_rows, k) identities of the first darts; rows without an element keep 0.

    The plane is cut into unit cells, weight by rank, of one dart on average. A
    row's ranks are searched up to a bound at which its darts hit all
    coordinates in 19 of 20 cases; the others go on with the ranks above it.
    """
    empty = np.iinfo(np.uint64).max
    best = np.full(n_rows * k, empty, dtype=U64)
    size = np.bincount(row, weights=weight, minlength=n_rows)
    levels = np.ceil(weight).astype(np.int64)
    low = np.zeros(n_rows, np.int64)
    high = np.ceil(k * (np.log(k) + 3) / np.maximum(size, 1)).astype(np.int64)
    pending = size > 0
    while pending.any():
        chosen = np.flatnonzero(pending[row])
        width = (high - low)[row[chosen]]
        cells = width * levels[chosen]
        member = np.repeat(np.arange(len(chosen)), cells)
        number = np.arange(len(member)) - np.repeat(np.cumsum(cells) - cells, cells)
        level, rank = number // width[member], number % width[member] + low[row[chosen]][member]
        cell = mix(hashes[chosen][member] ^ mix((level * 65_537 + rank).astype(U64), 11), 12)
        darts = np.searchsorted(_TABLE, (cell >> U64(11)).astype(np.float64) / 2.0**53)
        dart = np.repeat(np.arange(len(cell)), darts)
        code = mix(cell[dart] + (np.arange(len(dart)) - np.repeat(np.cumsum(darts) - darts, darts)).astype(U64), 13)
        owner = member[dart]
        hit = level[dart] + (mix(code, 15) >> U64(32)).astype(np.float64) / 2.0**32 < weight[chosen][owner]
        code, owner, dart = code[hit], owner[hit], dart[hit]
        slot = row[chosen][owner] * k + (mix(code, 16) % U64(k)).astype(np.int64)
        # rank with 20 bits below the point, then bits of the dart's identity
        at_rank = (rank[dart].astype(U64) << U64(20)) | (mix(code, 14) >> U64(44))
        np.minimum.at(best, slot, (at_rank << U64(28)) | (mix(code, 17) >> U64(36)))
        pending &= (best.reshape(n_rows, k) == empty).any(axis=1)
        low = np.where(pending, high, low)
        high = np.where(pending, high * 2, high)
    sig = best.reshape(n_rows, k)
    sig[size == 0] = 0
    return sig


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band."""
    key = np.zeros((len(sig), bands), dtype=U64)
    cut = sig.reshape(len(sig), bands, rows)
    for i in range(rows):
        key = mix(key ^ mix(cut[:, :, i], i), 20)
    return mix(key + np.arange(bands, dtype=U64)[None, :], 21)


def _sketch(docs: DataFrame, bands: int, rows: int, by_count: bool) -> DataFrame:
    """Per row: content keys, number of words, and the keys of its bands."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", 1_000_000):
                w = words(batch.column("text"))
                a, b = content_keys(w)
                h, row, count = shingles(w)
                n = batch.num_rows
                sig = signatures(h, row, count.astype(float) if by_count else np.ones(len(h)), n, bands * rows)
                keys = bands_of(sig, bands, rows)
                full = np.bincount(row, minlength=n) > 0
                columns = [batch.column("doc_id"), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.diff(w.rows)), to_rows(keys[full].ravel(), np.where(full, bands, 0))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key_a", "key_b", "n_words", "bands"])

    return docs.mapInArrow(emit, "doc_id long, key_a long, key_b long, n_words long, bands array<long>")


def _sets(docs: DataFrame, by_count: bool) -> DataFrame:
    """(doc_id, items, size): the upper halves of the sorted shingle hashes.

    With ``by_count`` the k-th occurrence of a shingle is an element of its own,
    which makes the weighted similarity by counts that of sets. Two different
    elements of a pair agree in 32 bits with a chance of n**2 / 2**32 for n
    elements each, which moves the similarity by less than 1e-5.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                h, row, count = shingles(words(batch.column("text")))
                if by_count:
                    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    h, row = np.repeat(h, count), np.repeat(row, count)
                    h = np.where(nth > 0, mix(h ^ nth.astype(U64), 22), h)
                    h = h[np.lexsort((h, row))]
                cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
                items = [(h[x:y] >> U64(32)).astype(np.uint32).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(items, pa.binary()), pa.array(np.diff(cut))], ["doc_id", "items", "size"])

    return docs.mapInArrow(emit, "doc_id long, items binary, size long")


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sorted sets of hashes."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) or not len(y):
        return 0.0
    i = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[i] == y).sum())
    return both / (len(x) + len(y) - both)


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose exact similarity reaches the threshold.

    Both joins are sort-merge joins, whose hot keys (hubs) Spark splits.
    """
    one = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("a_items"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("b_items"))
    joined = pairs.join(one, "a").join(two, "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similarity(x, y) >= threshold for x, y in zip(batch.column("a_items").to_pylist(), batch.column("b_items").to_pylist(), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return joined.mapInArrow(test, "a long, b long")


def _pairs(frame: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of the columns x and y."""
    return frame.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _across(open_docs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of ``open_docs(doc_id, class_id)`` of different classes that may reach the threshold.

    The elements of a set are ordered by how few of the documents hold them.
    Sets of n <= m elements that reach the threshold t have at least
    t / (1 + t) * (n + m) in common, so they share one of the first
    n - 2 * t / (1 + t) * n + 1 elements of the smaller and one of the first
    m - t * m + 1 of the larger, and not too late in either. Elements that one
    class alone has in its prefixes make no row. Of others, the class with most
    prefixes is only joined to the rest, so pairs within it are never made.
    """
    common = 2 * threshold / (1 + threshold)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, classes, blobs = batch.column("doc_id").to_numpy(), batch.column("class_id").to_numpy(), batch.column("items").to_pylist()
            total = np.cumsum([0, *map(len, blobs)]) // 4
            cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1] + SPREAD, SPREAD)).clip(0, len(blobs)))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # about SPREAD elements, or one larger document
                size = np.array([len(x) // 4 for x in blobs[a:b]])
                items = np.frombuffer(b"".join(blobs[a:b]), np.uint32).astype(np.int64)
                columns = [np.repeat(x, size) for x in (ids[a:b], classes[a:b], size)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(items)], ["doc_id", "class_id", "size", "item"])

    held = materialize(open_docs.join(sets.select("doc_id", "items"), "doc_id").mapInArrow(spread, "doc_id long, class_id long, size long, item long"))
    spreads = held.groupBy("item").agg(F.count("*").alias("n"), F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).where("lo < hi OR n > 1")
    # elements that a document holds alone come first in its order; they need no rank of their own
    ranked = held.join(spreads.hint("merge"), "item").groupBy("doc_id", "class_id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "item", (F.col("lo") < F.col("hi")).alias("mixed")))).alias("shared"))
    ranked = ranked.select("doc_id", "class_id", "size", F.posexplode("shared").alias("at", "e"), (F.col("size") - F.size("shared")).alias("alone"))
    placed = ranked.select("doc_id", "class_id", F.col("size").alias("n"), (F.col("alone") + F.col("at")).alias("at"), F.col("e.item").alias("item"), F.col("e.mixed").alias("mixed"))
    prefixes = materialize(placed.where(F.col("mixed") & (F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-6))))
    by_class = prefixes.groupBy("item", "class_id").agg(F.count("*").alias("times"))
    main = by_class.groupBy("item").agg(F.max(F.struct("times", "class_id"))["class_id"].alias("main"), F.count("*").alias("classes")).where("classes > 1").select("item", "main")
    marked = materialize(prefixes.drop("mixed").join(main.hint("merge"), "item").withColumn("rest", F.col("class_id") != F.col("main")).drop("main"))
    small = marked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * common - 1e-6))
    x, y = small.select("item", *[F.col(c).alias(f"x_{c}") for c in ("doc_id", "class_id", "n", "at", "rest")]), marked.select("item", *[F.col(c).alias(f"y_{c}") for c in ("doc_id", "class_id", "n", "at", "rest")])
    late = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) < (F.col("x_n") + F.col("y_n")) * (common / 2) - 1e-6
    fits = (F.col("x_class_id") != F.col("y_class_id")) & (F.col("x_n") <= F.col("y_n")) & (F.col("x_n") >= F.col("y_n") * threshold - 1e-6) & ~late

    def met(one: DataFrame, two: DataFrame) -> DataFrame:
        return one.hint("merge").join(two, (one["item"] == two["item"]) & fits).select(F.col("x_doc_id").alias("x"), F.col("y_doc_id").alias("y"))

    return _pairs(met(x.where("x_rest"), y).unionByName(met(x.where("NOT x_rest"), y.where("y_rest"))))


def components(links: DataFrame) -> DataFrame:
    """(doc_id, class_id): the least id that links reach, for every id in ``links(a, b)``.

    Minimum labels spread over links and then along labels (pointer jumping), so
    the number of rounds grows with the logarithm of a chain's length.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    label = materialize(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("doc_id"), F.least("a", "least").alias("class_id")))
    while True:
        seen = both.join(label, both.b == label.doc_id).groupBy("a").agg(F.min("class_id").alias("near"))
        nearer = label.join(seen, label.doc_id == seen.a).select("doc_id", F.col("class_id").alias("old"), F.least("class_id", "near").alias("class_id"))
        root = label.select(F.col("doc_id").alias("class_id"), F.col("class_id").alias("root"))
        new = materialize(nearer.join(root, "class_id", "left").select("doc_id", F.coalesce("root", "class_id").alias("class_id"), "old"))
        changed = new.where("class_id <> old").limit(1).count()
        label = new.select("doc_id", "class_id")
        if not changed:
            return label


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighting: str = "set") -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id and class_id, the least id of its class.

    Two documents are linked if the Jaccard similarity of their shingles reaches
    ``threshold``; with ``weighting="count"`` shingles weigh as often as they
    occur. Classes are connected by links.

    Documents with equal word sequences are one text. With the default bands a
    pair at 0.8 shares a bucket with probability 0.9999; no pair that shares one
    is lost.

    Null, empty and blank texts have no words and are a class each. Rows that
    share a doc_id share its class. A null id keeps a null class. Other columns
    are ignored.
    """
    ship(docs.sparkSession)
    by_count = weighting == "count"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = own.where("doc_id IS NOT NULL")
    sketch = materialize(_sketch(known, bands, rows, by_count))
    with_words = sketch.where("n_words > 0")
    same = materialize(with_words.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("text_id"), F.max("doc_id").alias("last")))
    copied = same.where("text_id < last").select("key_a", "key_b", "text_id")
    copies = materialize(with_words.select("doc_id", "key_a", "key_b").join(copied, ["key_a", "key_b"]).where("doc_id <> text_id").select("doc_id", "text_id"))
    texts = with_words.join(copies.select("doc_id").distinct(), "doc_id", "left_anti")
    entries = texts.select("doc_id", F.explode("bands").alias("bucket"))
    full = materialize(entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("h0"), F.max("doc_id").alias("last")).where("h0 < last").drop("last"))
    members = materialize(entries.join(full, "bucket"))

    known_buckets = members.groupBy("doc_id").agg(F.sum("n").alias("reach"))
    middle = members.join(known_buckets, "doc_id").groupBy("bucket").agg(F.max(F.struct("reach", "doc_id"))["doc_id"].alias("h1"), F.first("h0").alias("h0"))
    members = materialize(members.drop("h0").join(middle.hint("merge"), "bucket"))
    tested = materialize(_pairs(members.select(F.col("doc_id").alias("x"), F.explode(F.array("h0", "h1")).alias("y"))))
    wanted = tested.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # texts are large, so this join is a sort-merge join at every size
    sets = materialize(_sets(known.join(wanted.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), by_count))
    links = materialize(_verify(tested, sets, threshold))
    label = components(links)
    # Of three members, two hubs leave no pair untested; with four or more, or one hub, a bucket of several classes is open.
    placed = materialize(members.where("n > 3 OR n = 3 AND h0 = h1").join(label, "doc_id", "left").select("bucket", "doc_id", F.coalesce("class_id", "doc_id").alias("class_id")))
    split = placed.groupBy("bucket").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).where("lo < hi").select("bucket")
    open_docs = materialize(placed.join(split.hint("merge"), "bucket", "left_semi").select("doc_id", "class_id").distinct())
    if open_docs.limit(1).count():
        more = materialize(_across(open_docs, sets, threshold).join(tested, ["a", "b"], "left_anti"))
        links = materialize(links.unionByName(_verify(more, sets, threshold)))
        label = components(links)
    texts_of = copies.groupBy("doc_id").agg(F.min("text_id").alias("text_id"))
    ids = own.select("doc_id").join(texts_of, "doc_id", "left").withColumn("text_id", F.coalesce("text_id", "doc_id"))
    out = ids.join(label.withColumnRenamed("doc_id", "text_id"), "text_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "text_id").alias("class_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents whose class has a smaller id; all columns are kept.

    Rows with a null id stay. Rows that share a doc_id stay or go together.
    """
    gone = near_duplicates(docs, **options).where("class_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Class of near copies of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
