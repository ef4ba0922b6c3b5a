"""Periodic runs: block convolution at dyadic scales.

A run is a maximal stretch of words in which words that are q apart are equal. For
every scale D, blocks of min(D, BLOCK) words at multiples of D are compared with the
words that follow them at distances D to 2 * D - 1 (the least scale takes all
distances below 2 * D). The comparison is the sum of squared differences of word
codes, by a number-theoretic transform modulo the Fermat prime 65537; codes are
folded so far that the sum stays below the prime, so it is the exact integer, and
zero where the block occurs again. A distance with a zero is the seed of a
stretch: it is extended both ways, and what is long enough is compared word by word.

Every run of three periods and LEAST words has a block whose next occurrence lies
within it, so none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrowtext import U64, _Powers, mix
from docloom.llm.vocab import by_bytes
from docloom.runtime import ship

LEAST = 24  # words of a run, at least
PERIODS = 3  # periods of a run, at least
PRIME, GENERATOR = 65537, 3
RADIX = 32
FIRST = 8  # the least scale; a run of LEAST words with a shorter period holds a block of it and its repeat
BLOCK = 512  # words of a block, at most; longer windows are covered by more transforms
CELLS = 1 << 17  # cells of one batch of transforms

WORD = r"[^\x20\x09-\x0D]+"


class _Transform:
    """The transform of length n over rows, in steps of RADIX; products stay below 2**53, so doubles are exact."""

    made: dict[int, _Transform] = {}

    def __init__(self, n: int):
        self.n, self.rest = n, None
        root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
        if n > 2 * RADIX:
            self.rest = _Transform.of(n // RADIX)
            step = pow(root, n // RADIX, PRIME)
            self.there, self.back = _matrix(step, RADIX, RADIX), _matrix(pow(step, -1, PRIME), RADIX, RADIX)
            self.turn, self.turn_back = _matrix(root, RADIX, n // RADIX), _matrix(pow(root, -1, PRIME), RADIX, n // RADIX)
        else:
            self.there, self.back = _matrix(root, n, n), _matrix(pow(root, -1, PRIME), n, n)

    @classmethod
    def of(cls, n: int) -> _Transform:
        if n not in cls.made:
            cls.made[n] = cls(n)
        return cls.made[n]

    def forward(self, x: np.ndarray, inverse_root: bool = False) -> np.ndarray:
        """Values at the powers of the root (or of its inverse), in an order of its own."""
        first = self.back if inverse_root else self.there
        if self.rest is None:
            return _reduced(x @ first)
        y = _reduced(np.matmul(first, x.reshape(-1, RADIX, self.n // RADIX)))
        y = _reduced(y * (self.turn_back if inverse_root else self.turn))
        return self.rest.forward(y.reshape(-1, self.n // RADIX), inverse_root).reshape(-1, self.n)

    def undo(self, x: np.ndarray) -> np.ndarray:
        """n times what ``forward`` came from."""
        if self.rest is None:
            return _reduced(x @ self.back)
        y = self.rest.undo(x.reshape(-1, self.n // RADIX)).reshape(-1, RADIX, self.n // RADIX)
        return _reduced(np.matmul(self.back, _reduced(y * self.turn_back))).reshape(-1, self.n)


def _matrix(root: int, rows: int, columns: int) -> np.ndarray:
    """root ** (i * j) modulo the prime."""
    powers = np.ones(rows * columns, np.int64)
    for i in range(1, len(powers)):
        powers[i] = powers[i - 1] * root % PRIME
    return powers[np.outer(np.arange(rows), np.arange(columns))].astype(float)


def _reduced(x: np.ndarray) -> np.ndarray:
    """The residue, between -PRIME and 2 * PRIME at worst."""
    x -= PRIME * np.floor(x * (1.0 / PRIME))
    return x


def zero_mismatches(codes: np.ndarray, blocks: np.ndarray, size: int, shift: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) where the ``size`` words from ``blocks`` on equal those ``distance`` further on.

    Distances from ``shift`` to ``shift + span - 1`` are tried. ``codes`` are small
    numbers for which a sum of ``size`` squared differences is below PRIME; behind the
    last block there must be shift + span + size of them.
    """
    n = 1 << int(size + span - 2).bit_length()
    transform = _Transform.of(n)
    values = codes.astype(float)
    squares = np.concatenate([[0], np.cumsum(codes * codes)])
    scale = pow(n, -1, PRIME)
    found, far = [], []
    for a in range(0, len(blocks), max(1, CELLS // n)):
        at = blocks[a : a + max(1, CELLS // n)]
        pattern, window = np.zeros((len(at), n)), np.zeros((len(at), n))
        pattern[:, :size] = values[at[:, None] + np.arange(size)]
        window[:, : size + span - 1] = values[at[:, None] + np.arange(shift, shift + size + span - 1)]
        product = _reduced(transform.forward(pattern, inverse_root=True) * transform.forward(window))
        cross = transform.undo(product)[:, :span].astype(np.int64) % PRIME * scale
        begin = at[:, None] + np.arange(shift, shift + span)
        own = (squares[at + size] - squares[at])[:, None] + squares[begin + size] - squares[begin]
        row, column = np.nonzero((own - 2 * cross) % PRIME == 0)
        found.append(at[row])
        far.append(column + shift)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(far)


class _Equal:
    """How far two places of a sequence agree, by hashes of its stretches."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        up, self.down = _Powers.get(self.n + 1)
        self.sums = np.zeros(self.n + 1, U64)
        np.cumsum(mix(ids.astype(U64)) * up[: self.n], out=self.sums[1:], dtype=U64)

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[i + length] - self.sums[i]) * self.down[i] == (self.sums[j + length] - self.sums[j]) * self.down[j]

    def forward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and from j on, ``most`` at the most."""
        low, high = np.zeros_like(i), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = self.same(i, j, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    def backward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words before i and before j, ``most`` at the most."""
        low, high = np.zeros_like(i), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = self.same(i - middle, j - middle, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low


def find_runs(ids: np.ndarray, edges: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each sequence ids[edges[i]:edges[i + 1]], by start, then period.

    ``ids`` are numbers from 0 on, equal for equal words of a sequence.
    """
    sizes = np.diff(edges)
    equal = _Equal(ids)
    stretches: set[tuple[int, int, int]] = set()
    scale = FIRST
    while len(sizes) and sizes.max() >= max(LEAST, PERIODS * scale):
        size = min(scale, BLOCK)
        folded = ids % (int(((PRIME - 1) / size) ** 0.5) + 1)
        codes = np.concatenate([folded, np.zeros(2 * scale + 2 * size, np.int64)])
        least, span = (1, 2 * scale - 1) if scale == FIRST else (scale, size)
        rows = np.flatnonzero(sizes >= max(LEAST, PERIODS * scale))
        blocks = (sizes[rows] - size - least) // scale + 1  # of each sequence, with room for one repeat
        of = np.repeat(rows, blocks)
        at = edges[of] + (np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * scale
        for shift in [least] if scale == FIRST else range(scale, 2 * scale, size):
            room = at + shift + size <= edges[of + 1]
            of, at = of[room], at[room]
            begin, distance = zero_mismatches(codes, at, size, shift, span)
            owner = np.searchsorted(edges, begin, side="right") - 1
            good = begin + distance + size <= edges[owner + 1]
            stretches |= _extended(equal, edges, owner[good], begin[good], distance[good], size)
        scale *= 2
    least_period: dict[tuple[int, int], int] = {}
    for start, stop, period in stretches:
        least_period[start, stop] = min(period, least_period.get((start, stop), period))
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    for (start, stop), period in least_period.items():
        row = int(np.searchsorted(edges, start, side="right")) - 1
        if not np.array_equal(ids[start : stop - period], ids[start + period : stop]):
            raise ArithmeticError("two different stretches of words have the same hash")
        out[row].append((start - int(edges[row]), stop - start, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def _extended(equal: _Equal, edges: np.ndarray, owner: np.ndarray, begin: np.ndarray, distance: np.ndarray, size: int) -> set[tuple[int, int, int]]:
    """Maximal stretches (start, stop, period) around seeds, where long enough."""
    if not len(begin):
        return set()
    after = equal.forward(begin, begin + distance, edges[owner + 1] - begin - distance)
    true = after >= size  # folded codes may agree where words don't
    owner, begin, distance, after = owner[true], begin[true], distance[true], after[true]
    before = equal.backward(begin, begin + distance, begin - edges[owner])
    start, stop = begin - before, begin + distance + after
    enough = stop - start >= np.maximum(LEAST, PERIODS * distance)
    return set(map(tuple, np.unique(np.stack([start, stop, distance], axis=1)[enough], axis=0).tolist()))


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds behind its first period."""
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)])


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_words``, ``runs`` and ``collapsed`` of every whole text.

    ``runs`` are structs (start, length, period), counted in words, by start, then
    period; ``collapsed`` has the words that no run holds behind its first period,
    joined by one space. A null, empty or blank text has no words, no runs and an
    empty ``collapsed``. Repeated rows and null keys give a row each; other columns
    are ignored. No shuffle; each text is worked on alone, by slices of a few MB.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                texts = [(x or "").encode().split() for x in batch.column("text").to_pylist()]  # of bytes: at ASCII white space only
                numbers = []
                for words in texts:
                    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
                    numbers.append(np.array(list(map(number.__getitem__, words)), np.int64))
                edges = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
                runs = find_runs(np.concatenate([*numbers, np.zeros(0, np.int64)]), edges)
                collapsed = [_collapse(w, r).decode() for w, r in zip(texts, runs, strict=True)]
                found = [[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in runs]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.diff(edges)), pa.array(found, _RUNS), pa.array(collapsed, pa.string())], ["key", "n_words", "runs", "collapsed"])

    chosen = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"key {kind}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return chosen.mapInArrow(search, schema).withColumnRenamed("key", key)


def longest(runs) -> F.Column:
    """The run of greatest length by period; of equal ones the first. Null without runs."""
    better = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda best, x: F.when(better(best, x), x).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """Texts as the contract has them: in a tenth of the documents, by id, words from one place on repeat a stretch.

    A null id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = docs.withColumns({"h": h, "words": F.when(h % 10 == 0, words)})
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    cut = cut.withColumns({"n": n, "a": F.when(n > 0, g % n), "g": g})
    cut = cut.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    a, p = F.col("a"), F.col("p")
    moved = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return cut.select("doc_id", F.when(a.isNotNull(), F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Contract query: runs of every document, some with planted repeats; digests are taken from the operator's runs and texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("string").alias("text"))
    found = periodic_runs(planted(docs)).withColumn("best", longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
