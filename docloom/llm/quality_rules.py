"""Quality rules: a linear-chain conditional random field over lines.

Every line of a text gets features; Viterbi decoding of the field labels it as
content or boilerplate; the share of words in content lines decides whether the
document stays, after fixed base rules. The field is fitted here, on a bounded
sample of documents with a quality label. A label holds for a document, so the
lines of one alone never change label; the sequences that the field is fitted on
are therefore spliced: runs of lines of a good document with runs of a bad one
between them, as pages have their boilerplate between, before and after content.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrowtext import SPACES, U64, Words, mix, utf8, windows, words
from docloom.llm.vocab import by_bytes
from docloom.runtime import ship

SAMPLE_PER_LABEL = 1_000  # documents that the field is fitted on, at most, for each label
MIN_WORDS = 50
CONTENT_SHARE = 0.5
SEQUENCE = 48  # lines of a spliced sequence, about
STEPS, RATE, RIDGE, ENOUGH = 150, 0.2, 1e-3, 2e-4

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?=~^_{}[]\\/")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_POINT = np.array([b & 0xC0 != 0x80 for b in range(256)])  # a byte that begins a code point

FEATURES = ["bias", "symbols", "marks", "upper", "digits", "word_chars", "stutter", "repeated_line", "short"]


@dataclass
class Field:
    """Weights of a two-label chain: 0 boilerplate, 1 content."""

    weights: np.ndarray  # features x 2
    start: np.ndarray  # 2
    move: np.ndarray  # from x to


def _per_row(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[edges])


def base_counts(data: np.ndarray, offsets: np.ndarray, w: Words) -> dict[str, np.ndarray]:
    """Per row: n_words, word_chars, n_symbols, n_repeat_words."""
    n = len(w.hashes)
    three, at = windows(w, 3)
    row = w.row_of()
    _, inverse, times = np.unique(mix(three ^ mix(row[at].astype(U64))), return_inverse=True, return_counts=True)
    step = np.zeros(n + 1, np.int64)
    again = at[times[inverse] > 1] if len(at) else at
    np.add.at(step, again, 1)
    np.add.at(step, again + 3, -1)
    covered = np.cumsum(step[:-1]) > 0
    return {
        "n_words": np.diff(w.rows),
        "word_chars": _per_row(_POINT[data] & ~SPACES[data], offsets),
        "n_symbols": _per_row(_SYMBOL[data], offsets),
        "n_repeat_words": _per_row(covered, w.rows),
    }


def line_features(column: pa.Array, data: np.ndarray, offsets: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line with a word, its words, lines per row as offsets, n_dup_lines per row)."""
    cuts = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offsets, cuts + 1]))
    edges = edges[edges <= len(data)]
    if edges[-1] != len(data):
        edges = np.append(edges, len(data))
    first = np.searchsorted(w.starts, edges)  # the first word of each line
    n = np.diff(first)
    keep = n > 0
    lines = np.maximum(np.diff(edges), 1)
    same = np.zeros(len(w.hashes) + 1, bool)
    if len(w.hashes):
        same[1:-1] = (w.hashes[1:] == w.hashes[:-1]) & (w.row_of()[1:] == w.row_of()[:-1])
    starts = edges[:-1]
    dup = np.zeros(len(starts), bool)
    n_dup = np.zeros(len(offsets) - 1, np.int64)
    for i, text in enumerate(column.to_pylist()):
        k, seen = int(np.searchsorted(starts, offsets[i])), set()
        if not text:
            continue
        for j, line in enumerate(text.split("\n")):
            if line in seen:
                if line.strip(" \t\n\x0b\x0c\r"):
                    dup[k + j] = True
                    n_dup[i] += 1
            else:
                seen.add(line)
    share = lambda flags: _per_row(flags, edges) / lines
    chars = _per_row(_POINT[data] & ~SPACES[data], edges) / np.maximum(n, 1)
    stutter = np.diff(np.concatenate([[0], np.cumsum(same[:-1])])[first]) / np.maximum(n, 1)
    columns = [
        np.ones(len(n)), np.minimum(share(_SYMBOL[data]) * 20, 2), np.minimum(share(_MARK[data]) * 20, 2), share(_UPPER[data]) * 3, share(_DIGIT[data]) * 3,
        np.clip(chars / 6, 0, 3), np.minimum(stutter * 3, 3), dup.astype(float), (n < 5).astype(float),
    ]
    rows = np.searchsorted(starts[keep], offsets)
    return np.stack(columns, axis=1)[keep], n[keep], rows, n_dup


def _padded(x: np.ndarray, rows: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences ``which`` as one array (sequence, step, ...) and a mask."""
    sizes = (rows[1:] - rows[:-1])[which]
    longest = int(sizes.max(initial=1))
    at = rows[which][:, None] + np.arange(longest)[None, :]
    mask = np.arange(longest)[None, :] < sizes[:, None]
    return x[np.where(mask, at, 0)], mask


def splice(good: list[np.ndarray], bad: list[np.ndarray], seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, offsets, labels of lines) of sequences made of runs of good and of bad documents.

    Each document's lines are used once, in order; runs take 2 to 24 lines of one
    document, and a sequence has runs up to about SEQUENCE lines, of one kind or
    both. Made with a fixed seed, so equal samples give equal sequences.
    """
    rng = np.random.default_rng(seed)
    runs: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for kind, docs in ((0, bad), (1, good)):
        for x in docs:
            at = 0
            while at < len(x):
                n = int(rng.integers(2, 25))
                runs[kind].append(x[at : at + n])
                at += n
        runs[kind] = [runs[kind][i] for i in rng.permutation(len(runs[kind]))]
    parts, labels, sizes = [], [], [0]
    while runs[0] or runs[1]:
        total, kind = 0, int(rng.integers(2))
        while total < SEQUENCE and (runs[0] or runs[1]):
            kind = kind if runs[kind] else 1 - kind
            run = runs[kind].pop()
            parts.append(run)
            labels.append(np.full(len(run), kind))
            total += len(run)
            kind = 1 - kind if rng.random() < 0.6 else kind
        sizes.append(sizes[-1] + total)
    return np.concatenate(parts), np.array(sizes), np.concatenate(labels)


def fit(x: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> Field | None:
    """Maximum likelihood by gradient ascent with momentum; None where a label is missing.

    ``labels``: one for each line. Lines of both labels weigh the same in sum. It
    ends after STEPS steps, or once the gradient is below ENOUGH.
    """
    used = np.flatnonzero(rows[1:] > rows[:-1])
    if len(set(labels.tolist())) < 2:
        return None
    xs, mask = _padded(x.astype(np.float32), rows, used)
    y, _ = _padded(labels.astype(np.int64), rows, used)
    share = (y * mask).sum() / mask.sum()
    balance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) * mask
    weight = (balance.sum(1) / mask.sum(1) / mask.sum()).astype(np.float32)
    n, steps, k = xs.shape
    theta = np.zeros(k * 2 + 6)
    speed = np.zeros_like(theta)
    gold = (np.eye(2, dtype=np.float32)[y] * mask[:, :, None]).astype(np.float32)
    held = gold * weight[:, None, None]
    seen_w, seen_start, seen_move = np.einsum("ntk,ntl->kl", xs, held), held[:, 0].sum(0), np.einsum("nti,ntj->ij", gold[:, :-1], held[:, 1:])
    for _ in range(STEPS):
        w, start, move = (v.astype(np.float32) for v in (theta[: 2 * k].reshape(k, 2), theta[2 * k : 2 * k + 2], theta[2 * k + 2 :].reshape(2, 2)))
        local, jump = np.exp(xs @ w - (xs @ w).max(2, keepdims=True)), np.exp(move)
        alpha, beta = np.empty((n, steps, 2), np.float32), np.ones((n, steps, 2), np.float32)
        first = local[:, 0] * np.exp(start)
        alpha[:, 0] = first / first.sum(1, keepdims=True)
        for t in range(1, steps):
            reach = (alpha[:, t - 1] @ jump) * local[:, t]
            alpha[:, t] = np.where(mask[:, t, None], reach / reach.sum(1, keepdims=True), alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            after = (local[:, t + 1] * beta[:, t + 1]) @ jump.T
            beta[:, t] = np.where(mask[:, t + 1, None], after / after.sum(1, keepdims=True), 1)
        p = alpha * beta
        p *= (weight[:, None] * mask / p.sum(2))[:, :, None]
        pair = alpha[:, :-1, :, None] * jump * (local[:, 1:] * beta[:, 1:])[:, :, None, :]
        pair *= (weight[:, None] * mask[:, 1:] / pair.sum((2, 3)))[:, :, None, None]
        step = np.concatenate([(seen_w - np.einsum("ntk,ntl->kl", xs, p)).ravel(), seen_start - p[:, 0].sum(0), (seen_move - pair.sum((0, 1))).ravel()]) - RIDGE * theta
        if np.abs(step).max() < ENOUGH:
            break
        speed = 0.9 * speed + step
        theta = theta + RATE * speed * 10
    return Field(theta[: 2 * k].reshape(k, 2), theta[2 * k : 2 * k + 2], theta[2 * k + 2 :].reshape(2, 2))


def viterbi(field: Field, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The likeliest labels of all lines; sequences of like length are decoded together."""
    labels = np.ones(len(x), np.int8)
    sizes = np.diff(rows)
    scores = x @ field.weights
    for bits in np.unique(np.ceil(np.log2(np.maximum(sizes, 1)))):
        which = np.flatnonzero((sizes > 0) & (np.ceil(np.log2(np.maximum(sizes, 1))) == bits))
        if not len(which):
            continue
        s, mask = _padded(scores, rows, which)
        n, steps, _ = s.shape
        back = np.zeros((n, steps, 2), np.int8)
        best = s[:, 0] + field.start
        for t in range(1, steps):
            reach = best[:, :, None] + field.move
            back[:, t] = reach.argmax(1)
            best = np.where(mask[:, t, None], reach.max(1) + s[:, t], best)
        now = best.argmax(1)
        out = np.zeros((n, steps), np.int8)
        for t in range(steps - 1, -1, -1):
            out[:, t] = now
            now = np.where(mask[:, t], back[np.arange(n), t, now], now) if t else now
        labels[(rows[which][:, None] + np.arange(steps)[None, :])[mask]] = out[mask]
    return labels


def _train(docs: DataFrame, labels: DataFrame) -> Field | None:
    """Fit on at most SAMPLE_PER_LABEL documents for each label, chosen by a hash of their id.

    A document labelled both ways is left out; of rows that share an id, one is
    used, with all its lines.
    """
    order = F.xxhash64("doc_id")
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    rated = rated.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    chosen = None
    for label in (0, 1):
        part = rated.where(F.col("quality") == label).orderBy(order, "doc_id").limit(SAMPLE_PER_LABEL)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = chosen.collect()  # at most twice SAMPLE_PER_LABEL
    if len({r.quality for r in rows}) < 2:
        return None
    known = {r.doc_id: r.quality for r in rows}
    sample = docs.where(F.col("doc_id").isin(list(known)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                data, offsets = utf8(batch.column("text"))
                x, _, lines, _ = line_features(batch.column("text"), data, offsets, words(batch.column("text")))
                blobs = [x[a:b].astype(np.float32).tobytes() for a, b in zip(lines[:-1], lines[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(blobs, pa.binary())], ["doc_id", "x"])

    got = sample.mapInArrow(features, "doc_id long, x binary").groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    parts: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for r in sorted(got):
        parts[known[r.doc_id]].append(np.frombuffer(bytes(r.x), np.float32).reshape(-1, len(FEATURES)))
    if not sum(map(len, parts[0])) or not sum(map(len, parts[1])):
        return None
    return fit(*splice(parts[1], parts[0]))


def judge_quality(docs: DataFrame, labels: DataFrame, content_share: float = CONTENT_SHARE) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)`` and n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, content_words and kept.

    ``labels(doc_id, quality)`` may be empty or have one label only; then every
    line counts as content. A null or empty text has no words, fails the base
    rules and isn't kept. Repeated rows and null ids give a row each. A column of
    ``docs`` that is called like a result is replaced. No shuffle of texts.
    """
    ship(docs.sparkSession)
    results = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "content_words": "long", "kept": "boolean"}
    docs = docs.withColumn("text", F.col("text").cast("string")).drop(*results)
    field = _train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                column = batch.column("text")
                data, offsets = utf8(column)
                w = words(column)
                count = base_counts(data, offsets, w)
                x, n, lines, dup = line_features(column, data, offsets, w)
                content = viterbi(field, x, lines) if field is not None else np.ones(len(x), np.int8)
                inside = np.diff(np.concatenate([[0], np.cumsum(content * n)])[lines])
                failed = (count["n_words"] < MIN_WORDS) | (100 * count["n_repeat_words"] > 50 * count["n_words"])
                kept = ~failed & (inside >= content_share * count["n_words"])
                values = {**count, "n_dup_lines": dup, "base_failed": failed, "content_words": inside, "kept": kept}
                columns = [pa.array(values[k]).cast(pa.bool_() if kind == "boolean" else pa.int64()) for k, kind in results.items()]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *results])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{k} {v}" for k, v in results.items()])
    return docs.mapInArrow(judge, schema)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query: base counts and the verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge_quality(docs, labels).drop("text")
