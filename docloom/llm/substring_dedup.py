"""Substring dedup: rolling hashes of every fixed-length word window, counted in Spark.

Shuffling each window of each document would cost many times the input, so
windows that can't repeat are left out first, without any loss. Every window
has an *anchor*: the least, in a fixed order, of the hashes of its 4-word runs.
Equal windows have equal anchors, and neighbouring windows mostly share theirs,
so one row per change of anchor tells which windows can occur in two documents.
Only those are hashed, shuffled and compared.

Anchors that a bounded sample of documents shows to be frequent are known to
repeat; they skip the count, and their windows take a path that is aggregated
before it is shuffled and joined with skew handling. All others meet in groups
that are small against the number of documents. Both paths are exact.

Hashes have 64 bits: among n candidate windows about n**2 / 2**65 pairs of
different windows would be taken for equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrowtext import U64, Words, mix, windows, words
from docloom.llm.vocab import by_bytes
from docloom.runtime import materialize, ship

RUN = 4  # words of an anchor
SAMPLE_DOCS = 20_000
FREQUENT = 20  # documents of the sample that make an anchor frequent
SHORT_RUN_BYTES = 18


def content_keys(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's whole word sequence."""
    n = np.diff(w.rows)
    order = np.arange(len(w.hashes)) - np.repeat(w.rows[:-1], n)
    out = []
    for seed in (1, 2):
        each = mix(w.hashes ^ mix(order.astype(U64), seed), seed)
        total = np.concatenate([[U64(0)], np.cumsum(each, dtype=U64)])
        out.append(mix(total[w.rows[1:]] - total[w.rows[:-1]] + n.astype(U64), seed + 2))
    return out[0], out[1]


def anchored(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every window of ``size`` words, and the index of its first word.

    Runs of short words are common, so they come last in the order.
    """
    n, span = len(w.hashes), size - RUN + 1
    if n < size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    runs, first = windows(w, RUN)
    ends = np.concatenate([[0], np.cumsum(w.lengths)])
    short = ends[first + RUN] - ends[first] < SHORT_RUN_BYTES
    order = np.full(n, np.iinfo(np.uint64).max, dtype=U64)
    order[first] = (runs >> U64(1)) | (short.astype(U64) << U64(63))
    least, width = order, 1
    while width < span:  # doubling: the minimum over span runs in a few passes
        step = min(width, span - width)
        least, width = np.minimum(least[: len(least) - step], least[step:]), width + step
    row = w.row_of()
    at = np.flatnonzero(row[: n - size + 1] == row[size - 1 :])
    return least[at], at


def _ids(batch: pa.RecordBatch, rows: np.ndarray) -> pa.Array:
    return batch.column("doc_id").take(pa.array(rows))


def _anchor_rows(docs: DataFrame, size: int, frequent: np.ndarray | None = None, hot: bool = False) -> DataFrame:
    """(doc_id, anchor) at each change of anchor along a document: of frequent anchors, or of all others."""
    frequent = np.zeros(0, U64) if frequent is None else frequent

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                w = words(batch.column("text"))
                anchor, at = anchored(w, size)
                row = w.row_of()[at]
                new = np.ones(len(anchor), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                new &= np.isin(anchor, frequent) == hot
                yield pa.RecordBatch.from_arrays([_ids(batch, row[new]), pa.array(anchor[new].view(np.int64))], ["doc_id", "anchor"])

    return docs.mapInArrow(emit, "doc_id long, anchor long")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (anchor, doc_id): those of anchors with two documents or more.

    One row is held back until its anchor's next row is seen; nothing else is kept.
    """
    held: tuple[int, int] | None = None  # the only document so far of the last anchor
    known: int | None = None  # the last anchor, once it has two documents
    for batch in batches:
        anchor, doc = batch.column("anchor").to_numpy(), batch.column("doc_id").to_numpy()
        if held is not None:
            anchor, doc = np.concatenate([[held[0]], anchor]), np.concatenate([[held[1]], doc])
        if not len(anchor):
            continue
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], len(anchor)) - 1
        many = doc[first] != doc[last]
        many |= anchor[first] == known if known is not None else False
        keep = np.repeat(many, last - first + 1)
        held = None if many[-1] else (int(anchor[-1]), int(doc[-1]))
        known = int(anchor[-1]) if many[-1] else None
        yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(anchor[keep])], ["doc_id", "anchor"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (window, doc_id): those whose window has a smaller document."""
    window, smallest = None, None
    for batch in batches:
        w, doc = batch.column("window").to_numpy(), batch.column("doc_id").to_numpy()
        if not len(w):
            continue
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        least = doc[first].copy()
        if window is not None and w[0] == window:
            least[0] = smallest
        window, smallest = w[-1], least[-1]
        keep = doc > np.repeat(least, np.diff(np.append(first, len(w))))
        yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(w[keep])], ["doc_id", "window"])


def _window_rows(chosen: DataFrame, size: int, frequent: np.ndarray, hot: bool) -> DataFrame:
    """(doc_id, window) of the windows whose anchor is in the row's ``anchors``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                w = words(batch.column("text"))
                anchor, at = anchored(w, size)
                lists = batch.column("anchors").combine_chunks() if isinstance(batch.column("anchors"), pa.ChunkedArray) else batch.column("anchors")
                given = lists.flatten().to_numpy().view(U64)
                owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                row = w.row_of()[at]
                keep = np.isin(mix(anchor ^ mix(row.astype(U64))), mix(given ^ mix(owner.astype(U64))))
                keep &= np.isin(anchor, frequent) == hot
                window, _ = windows(w, size)
                pairs = np.unique(np.rec.fromarrays([row[keep], window[keep].view(np.int64)], names="r,w"))
                yield pa.RecordBatch.from_arrays([_ids(batch, pairs.r), pa.array(pairs.w)], ["doc_id", "window"])

    return chosen.mapInArrow(emit, "doc_id long, window long")


def _base(docs: DataFrame) -> DataFrame:
    """Per row: content keys, number of words, digest of all its words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                w = words(batch.column("text"))
                a, b = content_keys(w)
                digests = [hashlib.sha256(b" ".join((x or "").encode().split())).hexdigest() for x in batch.column("text").to_pylist()]
                columns = [batch.column("doc_id"), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.diff(w.rows)), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key_a", "key_b", "n_words", "digest"])

    return docs.mapInArrow(emit, "doc_id long, key_a long, key_b long, n_words long, digest string")


def _cut(marked: DataFrame, size: int) -> DataFrame:
    """Apply each row's removable ``windows``: merge them to intervals and drop their words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                w = words(batch.column("text"))
                key_a, key_b = content_keys(w)
                window, at = windows(w, size)
                first = np.searchsorted(at, w.rows)
                removed, texts = [], []
                for i, (text, gone) in enumerate(zip(batch.column("text").to_pylist(), batch.column("windows"), strict=True)):
                    mine = slice(first[i], first[i + 1])
                    starts = at[mine][np.isin(window[mine].view(np.int64), gone.values.to_numpy())] - w.rows[i]
                    step = np.zeros(w.rows[i + 1] - w.rows[i] + 1, np.int64)
                    np.add.at(step, starts, 1)
                    np.add.at(step, starts + size, -1)
                    covered = np.cumsum(step[:-1]) > 0
                    all_words = (text or "").encode().split()
                    texts.append(b" ".join([all_words[k] for k in np.flatnonzero(~covered)]).decode())
                    removed.append(int(covered.sum()))
                columns = [batch.column("doc_id"), pa.array(key_a.view(np.int64)), pa.array(key_b.view(np.int64)), pa.array(removed, pa.int64()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key_a", "key_b", "n_removed", "kept"])

    return marked.mapInArrow(emit, "doc_id long, key_a long, key_b long, n_removed long, kept string")


def _frequent(docs: DataFrame, size: int) -> np.ndarray:
    """Anchors that at least FREQUENT of about SAMPLE_DOCS documents share.

    At most (anchors of the sample) / FREQUENT values, whatever the input's size.
    They only choose between two exact paths.
    """
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = _anchor_rows(sample, size).distinct().groupBy("anchor").count().where(F.col("count") >= FREQUENT)
    return np.sort(np.array([r.anchor for r in rows.select("anchor").toLocalIterator()], dtype=np.int64)).view(U64)


def repeated_windows(docs: DataFrame, size: int = 13) -> tuple[DataFrame, DataFrame]:
    """(base, cut) for ``docs(doc_id, text)``.

    ``base``: per row its content keys, ``n_words``, ``digest`` and ``copy`` (a
    document with a smaller id has the same words). ``cut``: for each row that
    loses words and is no copy, ``n_removed`` and the ``kept`` text.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = materialize(_base(docs))
    same = materialize(base.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi"))
    base = base.join(same, ["key_a", "key_b"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("lo"), F.lit(False))).drop("lo")
    base = materialize(base)

    known = docs.where("doc_id IS NOT NULL")
    frequent = _frequent(known, size)
    shape = "doc_id long, anchor long"
    found = _anchor_rows(known, size, frequent).repartition("anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(_repeated, shape)
    if len(frequent):
        found = found.unionByName(_anchor_rows(known, size, frequent, True))
    copies = base.groupBy("doc_id").agg(F.min("copy").alias("copy")).where("copy").select("doc_id")
    flagged = found.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")).join(copies, "doc_id", "left_anti")
    chosen = materialize(known.join(flagged, "doc_id"))

    cold = _window_rows(chosen, size, frequent, False).repartition("window").sortWithinPartitions("window", "doc_id").mapInArrow(_later, "doc_id long, window long")
    gone = cold
    if len(frequent):
        common = _window_rows(chosen, size, frequent, True)
        smallest = materialize(common.groupBy("window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi"))
        gone = cold.unionByName(common.join(smallest, "window").where("doc_id > lo").select("doc_id", "window"))
    gone = gone.groupBy("doc_id").agg(F.collect_set("window").alias("windows"))
    cut = _cut(chosen.drop("anchors").join(gone, "doc_id"), size)
    return base, cut


def remove_repeated(docs: DataFrame, size: int = 13) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, n_words, n_removed, text`` without repeated windows.

    A word goes if a window of ``size`` words covers it whose words also start
    in a document with a smaller doc_id. Texts that lose nothing are returned
    unchanged; others are their kept words joined by one space.

    Null and empty texts have no words. Rows with a null doc_id lose nothing and
    take nothing from others. Rows that share a doc_id are one document: they
    don't take words from each other. Other columns are ignored.
    """
    base, cut = repeated_windows(docs, size)
    base = base.dropDuplicates(["doc_id", "key_a", "key_b"])
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = _keyed(own)
    cut = cut.groupBy("doc_id", "key_a", "key_b").agg(F.first("n_removed").alias("n_removed"), F.first("kept").alias("kept"))
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "key_a", "key_b")]
    joined = keyed.alias("d").join(base.alias("b"), on).select("d.*", "b.n_words", "b.copy").join(cut, ["doc_id", "key_a", "key_b"], "left")
    all_gone = F.col("copy") & (F.col("n_words") >= size)
    return joined.select(
        "doc_id", "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, "").when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")).alias("text"),
    )


def _keyed(docs: DataFrame) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                a, b = content_keys(words(batch.column("text")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["doc_id", "text", "key_a", "key_b"])

    return docs.mapInArrow(emit, "doc_id long, text string, key_a long, key_b long")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: words removed from every document, and a digest of what is kept."""
    size = 13
    base, cut = repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), size)
    keys = ["doc_id", "key_a", "key_b"]
    cut = cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    cut = cut.groupBy(*keys).agg(F.first("n_removed").alias("cut"), F.first("kept_sha256").alias("cut_sha256"))
    all_gone = F.col("copy") & (F.col("n_words") >= size)
    return base.join(cut, keys, "left").select(
        "doc_id", "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha256", "digest")).alias("kept_sha256"),
    )


#: The contract in DuckDB: window texts instead of hashes, and words removed one by one.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM d, unnest(range(1, len(ws) - 11)) AS t(i)),
m AS (SELECT k, min(doc_id) AS lo FROM w GROUP BY k),
g AS (SELECT DISTINCT doc_id, i + o AS j FROM w JOIN m ON w.k = m.k, unnest(range(0, 13)) AS t(o) WHERE lo < doc_id),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.j) AS kept FROM (SELECT doc_id, j, ws[j] AS word FROM d, unnest(range(1, len(ws) + 1)) AS t(j)) x ANTI JOIN g ON g.doc_id = x.doc_id AND g.j = x.j GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
